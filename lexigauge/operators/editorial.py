"""Differences between two versions of a text, and scans of one.

Nothing here rates prose: findings are places to look at.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns below say what counts as protected, as a quantity, as a
# word of logic, as a formula sign, as an invisible sign and as a soft pattern.
PROTECTED = re.compile(
    r"(?ms)^ {0,3}(?P<fence>`{3,}|~{3,})[^\n]*\n.*?^ {0,3}(?P=fence)[^\n]*(?:\n|$)"
    r"|(?P<ticks>`+)(?!`)(?:(?!(?P=ticks))[^\n])+?(?P=ticks)(?!`)"
    r"|\$\$.*?\$\$|(?<!\$)\$[^$\n]+\$|\\\[.*?\\\]|\\\(.*?\\\)|^>[^\n]*(?:\n|$)|https?://[^\s<>\]\)]+"
)
QUANTITY = re.compile(r"(?<![\w])(?:\d[\d,]*(?:\.\d+)?)(?:%|％)?|\d+(?:\.\d+)?(?:年|月|日|元|人|次|小时|分钟|公里|米|倍)")
LOGIC = re.compile(r"不超过|不少于|至少|至多|最多|仅限|仅|只有|除非|否则|如果|可能|推测|尚未|不得|不能|并非|不|未|no\b|not\b|only\b|unless\b|may\b", re.I)
SYMBOLS = "−≤≥≠∀∃∈∉⇒⇔"
INVISIBLE = "[\\x{0}-\\x{8}\\x{b}\\x{c}\\x{e}-\\x{1f}\\x{7f}\\x{200b}-\\x{200d}\\x{202a}-\\x{202e}\\x{2060}\\x{2066}-\\x{2069}\\x{feff}]"
SOFT = {
    "generic_opening": r"在(?:当今|这个|如今).{0,16}(?:时代|世界|背景)|In (?:today.s|the rapidly)",
    "automatic_closure": r"总而言之|综上所述|未来可期|Only time will tell|In conclusion",
    "inflated_significance": r"具有里程碑意义|彰显了|赋能|注入.{0,8}活力|game.chang|testament to",
    "performative_chat": r"希望这对你有帮助|问得好|让我们深入|I hope this helps|Great question",
    "balanced_template": r"不仅.{0,50}而且|不只是.{0,50}更是|虽然.{0,50}但是|not only.{0,60}but also",
    "citation_leak": r"contentReference\[|oaicite:|turn\d+(?:search|fetch)\d+|cite_start|\[INSERT [^\]]+\]",
}
PRESENTATION = {
    "presumed_reader_question": r"你(?:可能|也许|或许)会问|读者(?:可能|也许|往往|自然)?会问|不禁要问|再问(?:自己|一句)?|you (?:may|might) (?:ask|wonder)|one might ask",
    "staged_why_question": r"(?:为什么|为何)[^。！？?\n]{0,100}[？?]|(?<![A-Za-z])why(?![A-Za-z])[^.!?\n]{0,100}\?",
    "forced_reframing": r"不是[^。！？?\n]{0,100}而是|并非[^。！？?\n]{0,100}而是|(?<![A-Za-z])not(?![A-Za-z])[^.!?\n]{0,100}(?<![A-Za-z])but(?![A-Za-z])",
}
_DISPLAY = re.compile(r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|displaymath)\}.*?\\end\{\1\}", re.S)
DISPLAY_LIMIT = 3


#: Kinds of protected parts by what they start with.
_STARTS = (("$$", "display"), ("\\[", "display"), ("$", "inline"), ("\\(", "inline"), (">", "quote"), ("http", "address"))


class Scan:
    """One pass over a text: its protected parts by kind, and the rest at the same places."""

    def __init__(self, text: str):
        self.text, self.parts, pieces, at = text, [], [], 0
        for m in PROTECTED.finditer(text):
            a, b = m.span()
            self.parts.append((next((kind for start, kind in _STARTS if text.startswith(start, a)), "code"), a, b))
            pieces += [text[at:a], " " * (b - a)]
            at = b
        self.prose = "".join([*pieces, text[at:]])

    def literals(self) -> list[str]:
        """The protected parts as they stand."""
        return [self.text[a:b] for _, a, b in self.parts]

    def environments(self) -> list[tuple[int, int]]:
        """Display environments outside protected parts."""
        return [m.span() for m in _DISPLAY.finditer(self.prose)] if "\\begin{" in self.prose else []

    def displays(self) -> list[tuple[int, int]]:
        """Ranges of displayed mathematics by start; an inline formula alone on its line counts."""
        breaks = [-1, *(i for i, c in enumerate(self.text) if c == "\n"), len(self.text)] if any(k == "inline" for k, _, _ in self.parts) else []

        def alone(a: int, b: int) -> bool:
            before, after = breaks[bisect_left(breaks, a) - 1], breaks[bisect_left(breaks, b)]
            return not (self.text[before + 1 : a].strip() or self.text[b:after].strip())

        shown = [(a, b) for kind, a, b in self.parts if kind == "display" or (kind == "inline" and alone(a, b))]
        return sorted(shown + self.environments(), key=lambda r: r[0])

    def matches(self, patterns: dict[str, re.Pattern], without_displays: bool = False) -> list[tuple[str, int, int]]:
        """(kind, start, end) of patterns in the prose, kind by kind."""
        body = self.prose
        if without_displays:
            for a, b in self.environments():
                body = body[:a] + " " * (b - a) + body[b:]
        return [(kind, *m.span()) for kind, pattern in patterns.items() for m in pattern.finditer(body)]

    def counts(self) -> tuple[Counter, Counter, Counter]:
        """Quantities, words of logic and formula signs."""
        return Counter(QUANTITY.findall(self.prose)), Counter(LOGIC.findall(self.prose)), Counter(c for c in self.text if c in SYMBOLS)

    def repeated(self) -> list[tuple[str, int]]:
        """Paragraphs of prose that stand more than once, and how often."""
        return [(p, n) for p, n in Counter(map(str.strip, re.split(r"\n\s*\n", self.prose))).items() if p and n > 1]


_SOFT = {kind: re.compile(p, re.I) for kind, p in SOFT.items()}
_PRESENTATION = {kind: re.compile(p, re.I) for kind, p in PRESENTATION.items()}
_UNSEEN = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", INVISIBLE))


def protected(text: str) -> list[str]:
    """Code, mathematics, quoted lines and addresses, in order."""
    return Scan(text).literals()


def prose(text: str) -> str:
    """The text with protected parts blanked at the same length."""
    return Scan(text).prose


def displays(text: str) -> list[tuple[int, int]]:
    """Ranges of displayed mathematics, by start."""
    return Scan(text).displays()


def presentation(text: str | Scan) -> list[tuple[str, int | None, int | None]]:
    """(finding, start, end): displays beyond the budget, adjacent displays, staged questions and turns."""
    own = text if isinstance(text, Scan) else Scan(text)
    shown = own.displays()
    over = [("display_math_budget_exceeded", None, None)] * (len(shown) > DISPLAY_LIMIT)
    close = [("adjacent_display_math", a, d) for (a, b), (c, d) in pairwise(shown) if not own.text[b:c].strip()]
    return over + close + own.matches(_PRESENTATION, True)


def soft(text: str) -> list[tuple[str, int | None, int | None]]:
    """(kind, start, end) of soft patterns outside protected parts."""
    return Scan(text).matches(_SOFT)


def findings(documents: DataFrame, find) -> DataFrame:
    """``(doc_id, kind, start_cp, end_cp)`` of ``find(text)``; null texts have none."""
    rows = documents.where("text is not null").select("doc_id", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(d, *f) for d, t in zip(frame["doc_id"], frame["text"]) for f in find(t)]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "start_cp", "end_cp"]).astype({"start_cp": "Int64", "end_cp": "Int64"})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, start_cp long, end_cp long")


def protected_spans(documents: DataFrame) -> DataFrame:
    """``(doc_id, kind, start_cp, end_cp)`` of protected parts."""
    return findings(documents, lambda t: Scan(t).parts)


def presentation_findings(documents: DataFrame) -> DataFrame:
    """:func:`presentation` of every document."""
    return findings(documents, presentation)


def soft_findings(documents: DataFrame) -> DataFrame:
    """:func:`soft` of every document."""
    return findings(documents, soft)


def pattern_counts(documents: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``(doc_id, kind, n)``: matches of plain patterns in whole texts, on the JVM; kinds without match are left out."""
    counted = F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit("(?i)" + p)).cast("long").alias("n")) for k, p in patterns.items()))
    return documents.where("text is not null").select("doc_id", F.explode(counted).alias("x")).select("doc_id", "x.*").where("n > 0")


def invisible(documents: DataFrame) -> DataFrame:
    """``(doc_id, offset_cp, codepoint, name)`` of control, zero-width and direction signs."""
    hits = documents.where(F.col("text").rlike(INVISIBLE)).select("doc_id", F.posexplode(F.split("text", "")).alias("offset_cp", "c")).where(F.col("c").rlike(INVISIBLE))

    @F.pandas_udf("string")
    def name(chars: pd.Series) -> pd.Series:
        return chars.map(lambda c: unicodedata.name(c, "CONTROL"))

    point = F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("c")), 4, "0"))
    return hits.select("doc_id", F.col("offset_cp").cast("long").alias("offset_cp"), point.alias("codepoint"), name("c").alias("name"))


def multiset_diff(pairs: DataFrame, pattern: str) -> DataFrame:
    """``(pair_id, item, removed, added)`` of the matches of a pattern in ``original`` and ``candidate``.

    A null text has no matches; items as often in both are left out.
    """
    def side(c: str, sign: int) -> DataFrame:
        return pairs.select("pair_id", F.explode(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))).alias("item"), F.lit(sign).alias("v"))

    change = side("candidate", 1).unionByName(side("original", -1)).groupBy("pair_id", "item").agg(F.sum("v").alias("v")).where("v <> 0")
    return change.select("pair_id", "item", F.greatest(-F.col("v"), F.lit(0)).alias("removed"), F.greatest("v", F.lit(0)).alias("added"))


def lock_counts(pairs: DataFrame, locks: DataFrame) -> DataFrame:
    """``(pair_id, literal, n_original, n_candidate, state)``: "absent" from the original, "changed" or "kept".

    ``locks`` (``literal``, not empty) is a caller's list of literals that applies to every pair; it is read in one piece, and at most 10000 are taken.
    """
    literals = [r.literal for r in locks.where("literal is not null and literal <> ''").select("literal").distinct().orderBy("literal").limit(10_001).collect()]
    if len(literals) > 10_000:
        raise ValueError("at most 10000 locks")

    def count(c: str, x):
        text = F.coalesce(c, F.lit(""))
        return F.floor((F.length(text) - F.length(F.replace(text, x, F.lit("")))) / F.length(x))

    rows = pairs.select("pair_id", "original", "candidate", F.explode(F.array(*map(F.lit, literals)) if literals else F.array().cast("array<string>")).alias("literal"))
    sized = rows.select("pair_id", "literal", count("original", F.col("literal")).alias("n_original"), count("candidate", F.col("literal")).alias("n_candidate"))
    return sized.select("*", F.when(F.col("n_original") == 0, "absent").when(F.col("n_original") != F.col("n_candidate"), "changed").otherwise("kept").alias("state"))


def repeated_paragraphs(documents: DataFrame) -> DataFrame:
    """``(doc_id, paragraph_sha256, n)``: paragraphs of prose, between blank lines, that stand more than once."""
    rows = documents.where("text is not null").select("doc_id", "text")
    return _mapped(rows, "doc_id", "paragraph_sha256 string, n long", lambda text: [(hashlib.sha256(p.encode()).hexdigest(), n) for p, n in Scan(text).repeated()])


def _mapped(rows: DataFrame, key: str, columns: str, make) -> DataFrame:
    """``make`` of the other columns of each row, null as empty; each gives any number of rows."""
    names, others = [c.split()[0] for c in columns.split(", ")], [c for c in rows.columns if c != key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, *row) for k, *values in zip(frame[key], *(frame[c] for c in others)) for row in make(*(v or "" for v in values))]
            yield pd.DataFrame(out, columns=[key, *names])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {columns}")


def prose_diff(pairs: DataFrame, what: str) -> DataFrame:
    """``(pair_id, item, removed, added)`` of the "quantity", "logic" or "symbol" items of ``original`` and ``candidate``.

    Quantities and words of logic are read outside protected parts, signs everywhere. Items as often in both are left out; a null text has none.
    """
    which = ("quantity", "logic", "symbol").index(what)

    def make(a: str, b: str) -> list[tuple[str, int, int]]:
        old, new = Scan(a).counts()[which], Scan(b).counts()[which]
        return [(item, old[item] - new[item] if old[item] > new[item] else 0, max(0, new[item] - old[item])) for item in sorted({*old, *new}) if old[item] != new[item]]

    return _mapped(pairs.select("pair_id", "original", "candidate"), "pair_id", "item string, removed long, added long", make)


_REVIEW = ("n_quantity", "n_logic", "n_symbol", "n_invisible", "n_soft", "n_repeated", "n_presentation")


def review(pairs: DataFrame, locks: tuple[str, ...] = ()) -> DataFrame:
    """``(pair_id, protected_changed, locks_changed, n_quantity, n_logic, n_symbol, n_invisible, n_soft, n_repeated, n_presentation, status)``.

    "BLOCKED_PROTECTED_CHANGE" if protected parts differ, in any order, or a literal of ``locks`` stands another number of
    times; "REVIEW_REQUIRED" if anything else is found; else "NO_MECHANICAL_FINDINGS". A lock that the original lacks makes
    the pair "LOCK_ABSENT". A null text counts as empty. Both texts are scanned once.
    """
    if not all(isinstance(x, str) and x for x in locks):
        raise ValueError("every lock must be a string that is not empty")

    def make(a: str, b: str) -> list[tuple]:
        old, new = Scan(a), Scan(b)
        blocked = old.literals() != new.literals()
        changed = sum(a.count(x) != b.count(x) for x in locks)
        diffs = (sum(((x - y) + (y - x)).values()) for x, y in zip(old.counts(), new.counts()))
        found = (*diffs, len(_UNSEEN.findall(b)), len(new.matches(_SOFT)), len(new.repeated()), len(presentation(new)))
        if any(x not in a for x in locks):
            status = "LOCK_ABSENT"
        else:
            status = "BLOCKED_PROTECTED_CHANGE" if blocked or changed else "REVIEW_REQUIRED" if any(found) else "NO_MECHANICAL_FINDINGS"
        return [(blocked, changed, *found, status)]

    columns = "protected_changed boolean, locks_changed long, " + ", ".join(f"{n} long" for n in _REVIEW) + ", status string"
    return _mapped(pairs.select("pair_id", "original", "candidate"), "pair_id", columns, make)
