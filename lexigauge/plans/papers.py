"""Queries of the paper parser over the papers table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import papers as p
from ..sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return p.content(table(spark, d, "papers"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return p.parsed(_texts(spark, d))


_CONTENT = "texts AS (SELECT DISTINCT paper_id, coalesce(lower(trim(format)), 'latex') AS format, coalesce(source, 'caller-supplied') AS source, coalesce(text, array_to_string(chunks, '')) AS text FROM papers)"

QUERIES = {
    "paper_identity": (
        lambda spark, d: _texts(spark, d).select("paper_id", "format", "source", F.sha2("text", 256).alias("document_id"), F.length("text").cast("long").alias("n_chars")),
        f"WITH {_CONTENT} SELECT paper_id, format, source, sha256(text) AS document_id, length(text) AS n_chars FROM texts",
    ),
    "paper_nodes": (lambda spark, d: p.exploded(_parsed(spark, d), "nodes"), None),
    "paper_node_counts": (
        lambda spark, d: p.exploded(_parsed(spark, d).where("format = 'latex'"), "nodes").groupBy("paper_id", "kind").agg(F.count("*").alias("n")),
        f"""WITH {_CONTENT}, v AS (SELECT paper_id, regexp_replace(regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g'), '(^|[^\\\\])%[^\\n]*', '\\1', 'g') AS t FROM texts WHERE format = 'latex'),
k AS (SELECT paper_id, unnest(regexp_extract_all(t, '\\\\end\\{{(theorem|lemma|proposition|corollary|definition|remark|proof)\\}}', 1)) AS kind FROM v) SELECT paper_id, kind, count(*) AS n FROM k GROUP BY 1, 2""",
    ),
    "sections": (lambda spark, d: p.exploded(_parsed(spark, d), "sections"), None),
    "section_counts": (
        lambda spark, d: _parsed(spark, d).where("format <> 'latex'").select("paper_id", F.size("sections").cast("long").alias("n_sections")),
        f"WITH {_CONTENT} SELECT paper_id, len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s+[^\\n]+')) AS n_sections FROM texts WHERE format <> 'latex' AND length(trim(text)) > 0",
    ),
    "citations": (lambda spark, d: p.exploded(_parsed(spark, d), "citations"), None),
    "bibliography": (lambda spark, d: p.exploded(_parsed(spark, d), "bibliography"), None),
    "reference_candidates": (lambda spark, d: p.reference_candidates(_parsed(spark, d)), None),
    "ambiguous_labels": (lambda spark, d: p.ambiguous_labels(_parsed(spark, d)), None),
    "paper_revalidation": (
        lambda spark, d: p.changed(_parsed(spark, d), _parsed(spark, d).withColumn("nodes", F.when(F.crc32(F.col("paper_id").cast("binary")) % 5 == 0, F.slice("nodes", 2, 100000)).otherwise(F.col("nodes")))),
        None,
    ),
    "source_windows": (
        lambda spark, d: p.windows(_texts(spark, d)).select("paper_id", "start", "next_start", F.sha2("window", 256).alias("window_sha256")),
        f"""WITH {_CONTENT}, s AS (SELECT paper_id, text, unnest(range(0, greatest(length(text), 1), 20000)) AS start FROM texts)
SELECT paper_id, start, CASE WHEN start + 20000 < length(text) THEN start + 20000 END AS next_start, sha256(substring(text, start + 1, 20000)) AS window_sha256 FROM s""",
    ),
}
