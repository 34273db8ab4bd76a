"""Paragraphs, sentences and the eight surface features, at exact code points.

Nothing here shuffles a text: features come from per-document arrays in one narrow
pass, and only spans need a window over the pieces of a document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE

#: What is no content character (content is letters and numbers; CJK extension H is newer than the JVM's table).
OTHER = r"[^\p{L}\p{N}\x{31350}-\x{323af}]+"
#: Marks that always end a sentence, and what may close after them.
TERMINALS, CLOSERS = "。！？!?．", "”’」』）》】〕〗〙〛\"'"
#: Parts are joined by a code point that no text may hold.
CUT = "﷐"
_RUN = rf"((?:[{TERMINALS}]|(?<!(?<![A-Za-z])[A-Za-z])\.(?=[{SPACE}{CLOSERS}]|\z))[{TERMINALS}{CLOSERS}.]*)"

FEATURES = ("F002", "F003", "F013", "F014", "F015", "F016", "F024", "F025")


def content_chars(text: Column) -> Column:
    """Number of letters and numbers, 0 for an empty text, null for null."""
    return F.length(F.regexp_replace(text, OTHER, "")).cast("long")


def sentence_pieces(line: Column) -> Column:
    """The pieces of a line or text, each with its final marks; breaks of lines part them too."""
    return F.split(F.regexp_replace(line, _RUN, "$1" + CUT), rf"[\r\n{CUT}]")


def sentence_lengths(text: Column) -> Column:
    """Content characters of every sentence, in order."""
    return F.filter(F.transform(sentence_pieces(text), content_chars), lambda n: n > 0)


def _placed(pieces: DataFrame, order: list[str]) -> DataFrame:
    """Trimmed code-point ranges of the pieces with content; ``gap`` code points follow each piece."""
    before = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.length("piece") + F.col("gap")).over(before), F.lit(0))
    start = base + F.length("piece") - F.length(F.regexp_replace("piece", rf"^[{SPACE}]+", ""))
    size = F.length(F.regexp_replace("piece", rf"^[{SPACE}]+|[{SPACE}]+\z", ""))
    return pieces.select("doc_id", *order, start.cast("long").alias("start_cp"), (start + size).cast("long").alias("end_cp"), content_chars(F.col("piece")).alias("content_chars")).where("content_chars > 0")


def paragraphs(documents: DataFrame) -> DataFrame:
    """``(doc_id, paragraph, start_cp, end_cp, content_chars)``: maximal runs without line break that hold content.

    Null and contentless texts have none. ``doc_id`` must be unique; a null id counts as one document.
    """
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"[\r\n]")).alias("line", "piece"))
    spans = _placed(lines.withColumn("gap", F.lit(1)), ["line"])
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1
    return spans.select("doc_id", index.cast("long").alias("paragraph"), "start_cp", "end_cp", "content_chars")


def sentences(documents: DataFrame) -> DataFrame:
    """``(doc_id, sentence, paragraph, start_cp, end_cp, content_chars)`` of the operational sentences.

    Terminal marks absorb further marks and closers; a dot ends a sentence only
    before white space, a closer or the end, and not after a single ASCII letter.
    """
    lines = documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"[\r\n]")).alias("line", "text"))
    parts = F.split(F.regexp_replace("text", _RUN, "$1" + CUT), CUT)
    # The last piece of a line carries the line break's one code point.
    pieces = lines.select("doc_id", "line", F.posexplode(parts).alias("part", "piece"), F.size(parts).alias("parts"))
    spans = _placed(pieces.withColumn("gap", (F.col("part") == F.col("parts") - 1).cast("int")), ["line", "part"])
    whole = Window.partitionBy("doc_id").orderBy("line", "part")
    return spans.select("doc_id", (F.row_number().over(whole) - 1).cast("long").alias("sentence"), (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("line")) - 1).cast("long").alias("paragraph"), "start_cp", "end_cp", "content_chars")


def quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation at (n - 1) q of a sorted array, null when empty."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.try_element_at(ordered, low + 1), F.try_element_at(ordered, high + 1)
    return F.when(F.size(ordered) > 0, a + (b - a) * (at - low))


def lag1_spearman(lengths: pd.Series) -> pd.Series:
    """Rank correlation of neighbouring values of each array, ties ranked on average.

    Null below four values or without variance. Ranks of an array have no
    built-in form short of exploding it and shuffling twice, so the arrays of
    lengths alone go through Arrow.
    """
    out = []
    for values in lengths:
        if values is None or len(values) < 4:
            out.append(None)
            continue
        pair = []
        for part in (values[:-1], values[1:]):
            _, where, count = np.unique(part, return_inverse=True, return_counts=True)
            rank = (np.cumsum(count) - (count - 1) / 2)[where]
            pair.append(rank - rank.mean())
        scale = np.sqrt((pair[0] @ pair[0]) * (pair[1] @ pair[1]))
        out.append(float(pair[0] @ pair[1] / scale) if scale else None)
    return pd.Series(out, dtype="Float64")


def measured(documents: DataFrame) -> DataFrame:
    """One row per document: counts and the eight features, ``f002 .. f025``. No shuffle.

    A null text gives null counts and features; a text without content has zero counts.
    """
    by_line = F.filter(F.transform(F.split("text", r"[\r\n]"), sentence_lengths), lambda n: F.size(n) > 0)
    base = documents.select("doc_id", by_line.alias("paras")).select("doc_id", "paras", F.flatten("paras").alias("lens"))
    n = F.size("lens")
    counted = base.select(
        "doc_id", "lens", F.sort_array("lens").alias("ordered"),
        F.when(F.col("lens").isNotNull(), n).cast("long").alias("n_sentences"), F.when(F.col("lens").isNotNull(), F.size("paras")).cast("long").alias("n_paragraphs"),
        F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_content"),
        F.size(F.filter("paras", lambda x: F.size(x) == 1)).cast("long").alias("n_single"),
    )
    few = F.greatest(n - 1, F.lit(0))
    steps = F.zip_with(F.slice("lens", 1, few), F.slice("lens", 2, few), lambda a, b: F.abs(b - a))
    rho = F.pandas_udf(lag1_spearman, T.DoubleType())
    shaped = counted.withColumns({"median": quantile(F.col("ordered"), 0.5), "step_sum": F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), "f025": rho("lens")})
    shaped = shaped.withColumn("off", F.sort_array(F.transform("lens", lambda x: F.abs(x - F.col("median")))))
    return shaped.select(
        "doc_id", "n_sentences", "n_paragraphs", "n_content",
        F.try_divide(F.lit(1000.0) * F.col("n_paragraphs"), F.col("n_content")).alias("f002"),
        F.try_divide(F.col("n_single").cast("double"), F.col("n_paragraphs")).alias("f003"),
        F.col("median").alias("f013"),
        (quantile(F.col("ordered"), 0.75) - quantile(F.col("ordered"), 0.25)).alias("f014"),
        quantile(F.col("ordered"), 0.9).alias("f015"),
        F.try_divide(quantile(F.col("off"), 0.5), F.col("median")).alias("f016"),
        F.when(F.col("n_sentences") > 1, F.try_divide(F.col("step_sum") / F.greatest(F.col("n_sentences") - 1, F.lit(1)), F.col("median"))).alias("f024"),
        "f025",
    )


#: Of each feature: its unit of counting, and how many units make it comparable.
_RULES = {
    "F002": ("n_paragraphs", 5), "F003": ("n_paragraphs", 5), "F013": ("n_sentences", 10), "F014": ("n_sentences", 10),
    "F015": ("n_sentences", 20), "F016": ("n_sentences", 10), "F024": ("n_sentences", 20), "F025": ("n_sentences", 20),
}


def features_long(documents: DataFrame) -> DataFrame:
    """``(doc_id, feature_id, value, status, eligible)``: a value, an observed zero, or missing; nothing is imputed."""
    wide = measured(documents).where("n_content is not null")
    rows = F.array(*(F.struct(F.lit(f).alias("feature_id"), F.col(f.lower()).alias("value"), (F.col(unit) >= least).alias("enough")) for f, (unit, least) in _RULES.items()))
    long = wide.select("doc_id", "n_content", F.explode(rows).alias("r")).select("doc_id", "n_content", "r.*")
    status = F.when(F.col("value").isNull(), "unavailable").when(F.round("value", 9) == 0, "zero_observed").otherwise("observed")
    return long.select("doc_id", "feature_id", (F.round("value", 9) + 0.0).alias("value"), status.alias("status"), (F.col("value").isNotNull() & F.col("enough") & (F.col("n_content") >= 200)).alias("eligible"))


def review_locations(documents: DataFrame) -> DataFrame:
    """The shortest and the longest sentences of each document."""
    ends = Window.partitionBy("doc_id")
    found = sentences(documents).select("*", F.min("content_chars").over(ends).alias("low"), F.max("content_chars").over(ends).alias("high"))
    return found.where("content_chars in (low, high)").select("doc_id", "sentence", "start_cp", "end_cp", "content_chars")


def band_comparison(long: DataFrame, bands: DataFrame, source: str) -> DataFrame:
    """Features against the supported reference bands of ``source``; the flag is null unless the value is eligible.

    Bands are one row per feature of a source, a table of fixed size.
    """
    own = bands.where((F.col("source") == source) & F.col("supported")).select("feature_id", "q10", "q90")
    outside = F.when(F.col("eligible"), ~F.col("value").between(F.col("q10"), F.col("q90")))
    return long.join(own, "feature_id").select("doc_id", "feature_id", "value", "q10", "q90", "eligible", outside.alias("outside"))


def proxies(documents: DataFrame) -> DataFrame:
    """Per document, sentence and paragraph proxies counted in Han characters and words."""
    word = F.lit(r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+")

    def sizes(parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda t: F.regexp_count(t, word).cast("long")), lambda n: n > 0)

    by_sentence = sizes(F.split("text", rf"[。！？!?\n]+|\.(?:[{SPACE}]|\z)"))
    by_paragraph = sizes(F.split("text", r"\n[ \t\r\f\x0b]*\n"))
    return documents.where("text is not null").select(
        "doc_id", F.size(by_sentence).cast("long").alias("n_sentence_proxies"), F.coalesce(F.array_max(by_sentence), F.lit(0)).alias("longest_sentence"),
        F.size(by_paragraph).cast("long").alias("n_paragraph_proxies"), F.coalesce(F.array_max(by_paragraph), F.lit(0)).alias("longest_paragraph"),
    )
