"""Queries of the English instrument and of word shapes, over white-space tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import english as e
from ..sources.tables import table

_WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("lower(lang) = 'en' and text is not null").select("doc_id", "genre", "text")


_PREPARED = rf"""src AS (SELECT doc_id, genre, string_split_regex(regexp_replace(text, '^[{_WS}]+|[{_WS}]+\z', '', 'g'), '\n[{_WS}]*\n') AS ps FROM documents WHERE lower(lang) = 'en' AND text IS NOT NULL),
parts AS (SELECT doc_id, genre, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS paragraph FROM src),
tidy AS (SELECT doc_id, genre, paragraph, regexp_replace(regexp_replace(p, '[{_WS}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM parts),
prep AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*')) AS n_words FROM tidy)"""
_CUE = ", ".join(
    f"sum(len(regexp_extract_all(regexp_replace(' ' || lower(text) || ' ', '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '[^\\p{{L}}\\p{{N}}_]{c.replace(' ', '  ')}[^\\p{{L}}\\p{{N}}_]'))) AS c{i}" for i, c in enumerate(e.CUES)
)
_TOKENS = r"""tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}]+') AS ts FROM documents WHERE lower(lang) = 'en' AND text IS NOT NULL),
tokens AS (SELECT doc_id, unnest(ts) AS form, generate_subscripts(ts, 1) - 1 AS pos FROM tk)"""


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = e.tokens(_english(spark, d))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.round(F.avg(F.length("form")), 9).alias("mean_length"), F.round(F.avg((F.length("form") >= 4).cast("double")), 9).alias("share_ge4"),
        F.round(F.avg(F.col("form").rlike(r"^[\x{3400}-\x{9fff}]$").cast("double")), 9).alias("share_single_han"), F.round(F.avg(F.col("form").rlike("[a-zà-öø-ÿ]").cast("double")), 9).alias("share_latin"),
    )


_REFERENCE = [("encyclopedia", "<=500", 40, "n_words", 20.0, 300.0), ("encyclopedia", None, 80, "n_words", 30.0, 900.0), ("answer", "<=500", 4, "n_words", 1.0, 2.0), ("answer", None, 12, "n_words", 50.0, 700.0)]


def _strata(spark: SparkSession, d: str) -> DataFrame:
    words = e.prepared(_english(spark, d)).where("kept").groupBy("doc_id").agg(F.sum("n_words").alias("n_words"))
    rows = words.join(_english(spark, d).select("doc_id", "genre"), "doc_id").select("doc_id", "genre", "n_words", F.lit("n_words").alias("feature"), F.col("n_words").cast("double").alias("value"))
    ref = spark.createDataFrame(_REFERENCE, "genre string, band string, articles int, feature string, q10 double, q90 double")
    return e.strata(rows, ref).select("doc_id", "genre", "band", "value", "q10", "q90", "within")


QUERIES = {
    "english_prepare": (
        lambda spark, d: e.prepared(_english(spark, d)).select("doc_id", "paragraph", F.length("text").cast("long").alias("n_chars"), "n_words", "kept"),
        f"WITH {_PREPARED} SELECT doc_id, paragraph, length(text) AS n_chars, n_words, n_words >= 5 AS kept FROM prep",
    ),
    "english_elided": (lambda spark, d: e.elided(e.prepared(_english(spark, d)).where("kept")), None),
    "cue_rates": (
        lambda spark, d: e.cue_rates(e.prepared(_english(spark, d))),
        f"WITH {_PREPARED}, s AS (SELECT doc_id, sum(n_words)::BIGINT AS n_words, {_CUE} FROM prep WHERE n_words >= 5 GROUP BY 1) SELECT doc_id, n_words, "
        + ", ".join(f"round(1000.0 * c{i} / n_words, 9) AS cue_{c.replace(' ', '_')}" for i, c in enumerate(e.CUES))
        + " FROM s",
    ),
    "mattr": (
        lambda spark, d: e.mattr(e.tokens(_english(spark, d))),
        f"""WITH {_TOKENS}, p AS (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, form ORDER BY pos), -1) AS prev, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens)
SELECT doc_id, CASE WHEN n >= 100 THEN round(sum(greatest(least(pos, n - 100) - greatest(pos - 99, prev + 1, 0) + 1, 0)) / (100.0 * (n - 99)), 9) END AS mattr FROM p GROUP BY doc_id, n""",
    ),
    "token_shape": (
        _shapes,
        f"""WITH {_TOKENS} SELECT doc_id, count(*) AS n_tokens, round(avg(length(form)), 9) AS mean_length, round(avg((length(form) >= 4)::INT), 9) AS share_ge4,
round(avg(regexp_matches(form, '^[\\x{{3400}}-\\x{{9fff}}]$')::INT), 9) AS share_single_han, round(avg(regexp_matches(form, '[a-zà-öø-ÿ]')::INT), 9) AS share_latin FROM tokens GROUP BY 1""",
    ),
    "length_band": (
        _strata,
        f"""WITH {_PREPARED}, w AS (SELECT doc_id, genre, sum(n_words)::BIGINT AS n FROM prep WHERE n_words >= 5 GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN n <= 500 THEN '<=500' WHEN n <= 2000 THEN '501-2000' WHEN n <= 5000 THEN '2001-5000' ELSE '>5000' END AS band FROM w),
r AS (SELECT doc_id, genre, band, n::DOUBLE AS value, CASE WHEN genre = 'encyclopedia' AND band = '<=500' THEN 20.0 WHEN genre = 'encyclopedia' THEN 30.0 WHEN genre = 'answer' THEN 50.0 END::DOUBLE AS q10,
  CASE WHEN genre = 'encyclopedia' AND band = '<=500' THEN 300.0 WHEN genre = 'encyclopedia' THEN 900.0 WHEN genre = 'answer' THEN 700.0 END::DOUBLE AS q90 FROM b)
SELECT *, value BETWEEN q10 AND q90 AS within FROM r""",
    ),
    "language_guard": (
        lambda spark, d: table(spark, d, "documents").where("text is not null").select("doc_id", e.mostly_han(F.col("text")).alias("mostly_han")),
        "SELECT doc_id, length(regexp_replace(text, '[^\\x{3400}-\\x{9fff}]', '', 'g')) > greatest(10.0, length(text) * 0.05) AS mostly_han FROM documents WHERE text IS NOT NULL",
    ),
}
