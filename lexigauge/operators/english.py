"""The text-only part of the English instrument."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE

#: The phrases whose rates are measured.
CUES = (
    "for example", "for instance", "in particular", "on the other hand", "roughly speaking", "it turns out",
    "we now", "we first", "we can", "note that", "however", "therefore",
)
#: Limits of the length strata, in lexical words.
LENGTHS = ((500, "<=500"), (2000, "501-2000"), (5000, "2001-5000"))
_WORD = r"[A-Za-z]+(?:['’][A-Za-z]+)*"
_MATHS = re.compile(r"\\[A-Za-z]|[{}^_=<>∑∈∀∃]|(?<=[A-Za-z0-9])[+*/](?=[A-Za-z0-9])")
_SYMBOL = re.compile(r"[A-Za-z](?:[+-]\d+)?")


def mostly_han(text: Column) -> Column:
    """Whether a text has too many Han characters for the English instrument."""
    return F.regexp_count(text, F.lit(r"[\x{3400}-\x{9fff}]")) > F.greatest(F.lit(10.0), F.length(text) * F.lit(0.05))


def prepared(documents: DataFrame, least: int = 5) -> DataFrame:
    """``(doc_id, paragraph, text, n_words, kept)``: paragraphs parted by blank lines, spaces collapsed.

    Paragraphs with fewer than ``least`` English words are not kept but listed; null texts have none.
    """
    parts = F.split(F.regexp_replace("text", rf"^[{SPACE}]+|[{SPACE}]+\z", ""), rf"\n[{SPACE}]*\n")
    rows = documents.where("text is not null").select("doc_id", F.posexplode(parts).alias("paragraph", "p"))
    tidy = F.regexp_replace(F.regexp_replace("p", rf"[{SPACE}]+", " "), "^ | $", "")
    words = F.regexp_count(tidy, F.lit(_WORD)).cast("long")
    return rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), tidy.alias("text"), words.alias("n_words")).withColumn("kept", F.col("n_words") >= least)


def elided(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with dollar mathematics replaced by MATHEXPR; amounts of money stay."""

    def swap(m: re.Match) -> str:
        inner = m[0][1:-1].strip()
        return " MATHEXPR " if _MATHS.search(inner) or _SYMBOL.fullmatch(inner) else m[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [re.sub(r"\$[^$]*\$", swap, t) for t in frame["text"]]
            yield frame

    return paragraphs.mapInPandas(run, paragraphs.schema)


def cue_rates(paragraphs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, cue_...)``: phrases per 1000 words over the kept paragraphs."""
    low = F.lower("text")
    counts = [F.sum(F.regexp_count(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){cue}(?![\p{{L}}\p{{N}}_])"))).alias(cue) for cue in CUES]
    sums = paragraphs.where("kept").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), *counts)
    return sums.select("doc_id", "n_words", *((F.round(F.lit(1000.0) * F.col(c) / F.col("n_words"), 9)).alias("cue_" + c.replace(" ", "_")) for c in CUES))


def tokens(documents: DataFrame) -> DataFrame:
    """``(doc_id, pos, form)``: runs of letters, lower case, in order; numbers and marks are no tokens."""
    return documents.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("pos", "form"))


def mattr(rows: DataFrame, k: int = 100) -> DataFrame:
    """``(doc_id, mattr)``: mean share of distinct forms over all windows of ``k`` tokens, null for shorter texts.

    Each token counts in the windows that hold it and not its previous like, so no window is built.
    """
    spot = Window.partitionBy("doc_id", "form").orderBy("pos")
    size = F.count("*").over(Window.partitionBy("doc_id"))
    placed = rows.select("doc_id", "pos", F.coalesce(F.lag("pos").over(spot), F.lit(-1)).alias("prev"), size.alias("n"))
    first = F.greatest(F.col("pos") - (k - 1), F.col("prev") + 1, F.lit(0))
    last = F.least(F.col("pos"), F.col("n") - k)
    new = F.greatest(last - first + 1, F.lit(0))
    sums = placed.groupBy("doc_id", "n").agg(F.sum(new).alias("s"))
    return sums.select("doc_id", F.when(F.col("n") >= k, F.round(F.col("s") / (F.lit(float(k)) * (F.col("n") - k + 1)), 9)).alias("mattr"))


def length_band(words: Column) -> Column:
    """The length stratum of a count of words."""
    out = F.lit(">5000")
    for limit, name in reversed(LENGTHS):
        out = F.when(words <= limit, name).otherwise(out)
    return out


def strata(measured: DataFrame, reference: DataFrame, least: int = 10) -> DataFrame:
    """``measured`` with ``within``: inside the band of genre and length, or of the genre where that has under ``least`` articles.

    ``measured``: ``doc_id, genre, n_words, feature, value``; ``reference``: ``genre, band`` (null for the genre as a whole), ``articles, feature, q10, q90``.
    """
    keyed = measured.withColumn("band", length_band(F.col("n_words")))
    fine = reference.where(f"band is not null and articles >= {least}").select("genre", "band", "feature", F.col("q10").alias("l1"), F.col("q90").alias("h1"))
    broad = reference.where("band is null").select("genre", "feature", F.col("q10").alias("l2"), F.col("q90").alias("h2"))
    both = keyed.join(fine, ["genre", "band", "feature"], "left").join(broad, ["genre", "feature"], "left")
    low, high = F.coalesce("l1", "l2"), F.coalesce("h1", "h2")
    return both.select("doc_id", "genre", "band", "feature", "value", low.alias("q10"), high.alias("q90"), F.col("value").between(low, high).alias("within"))
