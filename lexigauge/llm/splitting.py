"""Problem 4: items over a size limit cut into overlapping pieces at natural boundaries.

Each piece ends at the strongest boundary of the upper part of its length window
or, where that holds no sentence end or stronger one, of the whole window, found
by a sparse-table range maximum; ties go to the right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded

#: Kinds of boundary, weakest first; a later one wins at the same place. The cut is where the match's group "at" starts, else where the match ends.
_BOUNDARIES = (
    (1, re.compile(r"\s+")),
    (2, re.compile(r"[,;:，；：、،]\s*")),
    (3, re.compile(r"(?:(?<!\b[^\W\d_])[.!?؟।](?=[\s\"'”’»)\]])|[。！？．])[.!?。！？”’»」』）)\]\"']*\s*")),
    (4, re.compile(r"\r\n|[\r\n]")),
    (5, re.compile(r"(?:\r\n|\r(?!\n)|\n)[^\S\r\n]*(?:\r\n|\r(?!\n)|\n)\s*")),
    (5, re.compile(r"(?:^|(?<=[\r\n]))(?P<at>)\\(?:begin)\{|\\end\{[^}\r\n]*\}(?:\r\n|[\r\n])?")),
    (6, re.compile(r"(?:^|(?<=[\r\n]))(?P<at>)(?:#{1,6}[^\S\r\n]|\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?[\[{])")),
)


#: The least strength of a boundary for which the lower part of a window is searched too: a sentence end.
_NATURAL = 3


class _RangeMaximum:
    """Greatest of ``values[i:j]`` in constant time."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (half := 1 << (len(self.levels) - 1)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def over(self, i: int, j: int) -> int:
        k = (j - i).bit_length() - 1
        return int(max(self.levels[k][i], self.levels[k][j - (1 << k)]))


def pieces(text: str, most: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int]]:
    """Half-open code-point ranges of the pieces of ``text``; one range if it fits.

    Every piece has at most ``most`` code points; each but the first begins with
    the last ``overlap`` code points of the one before. A cut is searched
    among piece lengths from ``fill * most`` (more than the overlap) to ``most``.
    Where no sentence end or stronger boundary stands there, one among the
    shorter lengths (more than the overlap) comes before a clause end or space of
    that part; clause ends and spaces of the shorter lengths come before no
    boundary at all. Without any the piece has the full length, but a CR LF
    pair is not parted.
    """
    n = len(text)
    if n <= most:
        return [(0, n)]
    if most <= overlap or overlap < 0:
        raise ValueError("the overlap must be at least 0 and less than the size limit")
    strength = np.zeros(n + 1, np.int8)
    for level, pattern in _BOUNDARIES:
        at = pattern.groupindex.get("at")
        spots = [m.start("at") if at and m.start("at") >= 0 else m.end() for m in pattern.finditer(text)]
        if spots:
            strength[np.asarray(spots)] = np.maximum(strength[np.asarray(spots)], level)
    spots = np.flatnonzero(strength)
    best = _RangeMaximum(strength[spots].astype(np.int64) * (n + 1) + spots)
    out, start = [], 0
    while n - start > most:
        low, high = start + max(overlap + 1, int(fill * most)), start + most
        first, i, j = map(int, np.searchsorted(spots, [start + overlap + 1, low, high + 1]))
        upper = best.over(i, j) if i < j else 0
        if upper < _NATURAL * (n + 1) and first < j:
            whole = best.over(first, j)
            if not upper or whole >= _NATURAL * (n + 1):
                upper = whole
        if upper:
            end = upper % (n + 1)
        else:
            end = high - (text[high - 1 : high + 1] == "\r\n" and high - 1 - start > overlap)
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_items(
    items: DataFrame, limits: DataFrame, item_id: str = "paper_id", text: str = "text", chunks: str = "chunks", format_col: str = "format",
    default_format: str = "latex", with_text: bool = True,
) -> DataFrame:
    """``(item_id, format, piece, pieces, start_cp, end_cp, n_chars[, text])``: the pieces of every item.

    The content is ``text``, or else the chunks joined without separator; an item
    with neither, or an empty one, is one empty piece. Items within the limit are
    one piece. A null format is ``default_format``; formats are compared without
    case and outer spaces; an unknown one has no limit, as a null limit has none.
    Repeated rows (same id, format and content) count once; rows of one id with
    other content stay apart. Null ids are kept. Other columns are not read.
    ``limits`` must have at most 1000 rows.
    """
    known = limits.select(folded(F.col("format")).alias("f"), "max_code_points", "overlap_code_points").where("f is not null and max_code_points is not null").limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("limits is a table of formats and has at most 1000 rows")
    sizes = {r.f: (r.max_code_points, r.overlap_code_points or 0) for r in known}
    rows = items.select(
        F.col(item_id).alias("item_id"),
        F.coalesce(folded(F.col(format_col)), F.lit(default_format)).alias("format"),
        F.coalesce(F.col(text), F.array_join(F.col(chunks), ""), F.lit("")).alias("content"),
    ).dropDuplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, kind, content in zip(frame["item_id"], frame["format"], frame["content"]):
                most, overlap = sizes.get(kind, (max(1, len(content)), 0))
                cuts = pieces(content, most, overlap)
                out += [(name, kind, k, len(cuts), a, b, b - a, *([content[a:b]] * with_text)) for k, (a, b) in enumerate(cuts)]
            yield pd.DataFrame(out, columns=["item_id", "format", "piece", "pieces", "start_cp", "end_cp", "n_chars", *["text"] * with_text])

    kind = rows.schema["item_id"].dataType.simpleString()
    made = rows.mapInPandas(run, f"item_id {kind}, format string, piece long, pieces long, start_cp long, end_cp long, n_chars long" + ", text string" * with_text)
    return made.withColumnRenamed("item_id", item_id)
