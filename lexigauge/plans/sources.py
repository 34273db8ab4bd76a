"""Queries of sources, uploads and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards
from ..operators import components as c
from ..sources.files import verified
from ..sources.tables import table
from ..streaming.uploads import assembled
from .components import _DIFF, _ROWS, _obs, _sig, significant


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "papers").where("chunks is not null")
    parts = rows.select(F.col("paper_id").alias("upload_id"), F.size("chunks").alias("total"), "format", F.lit("papers").alias("source"), F.posexplode("chunks").alias("idx", "text"))
    # Every third upload lacks its last chunk.
    lacks = (F.crc32(F.col("upload_id").cast("binary")) % 3 == 0) & (F.col("total") > 1) & (F.col("idx") == F.col("total") - 1)
    return parts.where(~lacks)


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    files = docs.where("doc_id % 10 <> 3").select(F.concat(F.lit("in/"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    listed = docs.where("doc_id % 10 <> 4").select(F.col("doc_id").cast("string").alias("name"), F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha256"))
    return verified(files, listed).select("name", "state")


def _card(spark: SparkSession, d: str) -> DataFrame:
    rows = c.contrasts(c.long(_obs(spark, d))).select("split", F.concat_ws("/", "source", "feature_id").alias("feature_id"), F.col("human_minus_chatgpt").alias("difference"), (F.col("paired_components") >= 2).alias("supported"))
    return cards.general(rows.where("split = 'TRAIN'"), rows.where("split = 'DEV'")).select("feature_id", significant(F.col("train")).alias("train"), significant(F.col("dev")).alias("dev"), "same_sign")


QUERIES = {
    "chunk_assembly": (
        lambda spark, d: assembled(_chunks(spark, d)).select("upload_id", F.col("state").isin("complete", "incomplete").alias("accepted")),
        "SELECT DISTINCT paper_id AS upload_id, list_sum(list_transform(chunks, lambda x: length(x))) <= 2000000 AS accepted FROM papers WHERE chunks IS NOT NULL",
    ),
    "chunk_texts": (
        lambda spark, d: assembled(table(spark, d, "papers").where("chunks is not null").select(F.col("paper_id").alias("upload_id"), F.size("chunks").alias("total"), "format", F.lit("papers").alias("source"), F.posexplode("chunks").alias("idx", "text"))).select("upload_id", "state", "sha256"),
        "SELECT DISTINCT paper_id AS upload_id, 'complete' AS state, sha256(array_to_string(chunks, '')) AS sha256 FROM papers WHERE chunks IS NOT NULL",
    ),
    "manifest_check": (
        _manifest,
        "SELECT doc_id::VARCHAR AS name, CASE doc_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'unlisted' WHEN 5 THEN 'changed' ELSE 'ok' END AS state FROM documents WHERE text IS NOT NULL",
    ),
    "card_mismatches": (
        lambda spark, d: cards.unmatched(*(c.contrasts(c.long(_obs(spark, d))).where((F.col("split") == split) & (F.col("paired_components") >= 10)).select(F.concat_ws("/", "source", "feature_id").alias("feature_id")) for split in ("TRAIN", "DEV"))),
        f"""WITH {_ROWS}, {_DIFF}, x AS (SELECT split, source || '/' || feature_id AS feature_id FROM diffs GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT feature_id, CASE min(split) WHEN 'TRAIN' THEN 'train' ELSE 'dev' END AS side FROM x GROUP BY 1 HAVING count(*) = 1""",
    ),
    "contrast_card": (
        _card,
        f"""WITH {_ROWS}, {_DIFF}, x AS (SELECT split, source || '/' || feature_id AS feature_id, count(*) AS n, avg(d) AS m FROM diffs GROUP BY 1, 2)
SELECT a.feature_id, {_sig('a.m')} AS train, {_sig('b.m')} AS dev, sign(a.m) = sign(b.m) AS same_sign FROM x a JOIN x b USING (feature_id) WHERE a.split = 'TRAIN' AND b.split = 'DEV' AND a.n >= 2 AND b.n >= 2""",
    ),
}
