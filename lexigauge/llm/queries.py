"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from ..sources.tables import cut, table
from .contamination import held_items
from .grouping import assign_splits, broken_ties, deviations
from .leakage import leak_members, leaks
from .quantiles import BUFFER, PERCENTS, combine, once, percentiles, sketches
from .sentences import sentence_units
from .splitting import split_items
from .tokens import encode_column
from .toxicity import scores


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of document ids that overlap across TRAIN and evaluation."""
    return leaks(table(spark, folder, "measured_documents"), table(spark, folder, "style_observations")).select("id_a", "id_b")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs per evaluation split and source."""
    found = leaks(table(spark, folder, "measured_documents"), table(spark, folder, "style_observations"))
    return found.groupBy("eval_split", "source").agg(
        F.count("*").alias("n_pairs"), F.sum(F.array_contains("kinds", "near_text").cast("long")).alias("n_near_text"), F.round(F.avg("containment"), 9).alias("mean_containment")
    )


def p1_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair with the part of the evaluation text that stands in the training text."""
    return leaks(table(spark, folder, "measured_documents"), table(spark, folder, "style_observations"))


def p1_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every document on either side with its class of equal texts and its number of links."""
    return leak_members(table(spark, folder, "measured_documents"), table(spark, folder, "style_observations"))


def _sketched(spark: SparkSession, folder: str, k: int = BUFFER) -> DataFrame:
    by = ["source", "condition"]
    return combine(cut(sketches(once(table(spark, folder, "style_observations")), by, k=k), "sketches"), by, k=k)


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per source, condition and feature, with their rank error bound."""
    return percentiles(_sketched(spark, folder), ["source", "condition"])


def p2_from_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same, combined from sketches of single days."""
    by = ["source", "condition"]
    days = combine(cut(sketches(once(table(spark, folder, "style_observations")), [*by, "day"]), "sketches"), [*by, "day"])
    return percentiles(combine(cut(days, "days"), by), by)


def p2_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Per group, whether every percentile's true rank is within the stated bound."""
    return _verified(spark, folder, _sketched(spark, folder))


def _verified(spark: SparkSession, folder: str, made: DataFrame) -> DataFrame:
    keys = ["source", "condition", "feature_id"]
    answers = cut(percentiles(made, ["source", "condition"]), "answers")
    stacked = answers.select(*keys, "n", "rank_error", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(f"p{p:02d}").alias("v")) for p in PERCENTS))).alias("a")).select(*keys, "n", "rank_error", "a.*")
    values = once(table(spark, folder, "style_observations")).select("source", "condition", F.explode("features").alias("feature_id", "value")).where("value is not null and not isnan(value) and abs(value) < double('Infinity')")
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    ranks = values.alias("x").join(stacked.alias("y"), same).groupBy(*(F.col(f"y.{k}") for k in keys), "n", "rank_error", "p").agg(
        F.sum((F.col("value") < F.col("v")).cast("long")).alias("below"), F.sum((F.col("value") <= F.col("v")).cast("long")).alias("upto")
    )
    wanted = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") / 100))
    off = F.greatest(F.lit(0), F.col("below") + 1 - wanted, wanted - F.col("upto"))
    return ranks.groupBy(*keys, "n").agg(F.min(off <= F.col("rank_error")).alias("within_bound"))


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """The same for sketches of so small buffers that they collapse many times."""
    return _verified(spark, folder, _sketched(spark, folder, 32))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence unit of every distinct measured document."""
    return sentence_units(table(spark, folder, "measured_documents")).select("document_id", "start_cp", "end_cp")


def p3_units(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the count of content characters."""
    return sentence_units(table(spark, folder, "measured_documents"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Papers longer than the limit of their format."""
    cut = split_items(table(spark, folder, "papers"), table(spark, folder, "size_limits"), with_text=False)
    return cut.where("pieces > 1").select("paper_id").distinct()


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every paper."""
    return split_items(table(spark, folder, "papers"), table(spark, folder, "size_limits"))


def p4_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Per oversized paper, whether its pieces keep the limit, overlap as told, and give back the whole text."""
    limits = table(spark, folder, "size_limits").select(folded(F.col("format")).alias("format"), "max_code_points", "overlap_code_points")
    made = split_items(table(spark, folder, "papers"), table(spark, folder, "size_limits")).where("pieces > 1").join(F.broadcast(limits), "format")
    before = Window.partitionBy("paper_id", "format", "pieces").orderBy("piece")
    last, end = F.lag("text").over(before), F.lag("end_cp").over(before)
    fits = (F.col("n_chars") <= F.col("max_code_points")) & (F.length("text") == F.col("n_chars")) & (F.col("end_cp") - F.col("start_cp") == F.col("n_chars"))
    overlaps = F.when(end.isNull(), F.col("start_cp") == 0).otherwise(
        (F.col("start_cp") == end - F.col("overlap_code_points")) & (F.right(last, F.col("overlap_code_points").cast("int")) == F.left("text", F.col("overlap_code_points").cast("int")))
    )
    checked = made.select("paper_id", "end_cp", (fits & overlaps).alias("ok"))
    return checked.groupBy("paper_id").agg(F.max("end_cp").alias("n_chars"), F.min("ok").alias("kept"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Observation ids in linked sets that hold more than one split."""
    return broken_ties(table(spark, folder, "style_observations"), table(spark, folder, "measured_documents")).select("id").distinct()


def p5_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """A split for every observation id, whole linked sets together."""
    return assign_splits(*(table(spark, folder, t) for t in ("style_observations", "measured_documents", "split_targets"))).select("id", "split")


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the assignment reaches."""
    got = p5_assignment(spark, folder).groupBy("split").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return got.join(table(spark, folder, "split_targets"), "split").select("split", F.col("share").alias("target"), "n", F.round(F.col("n") / total, 6).alias("share"))


def p5_deviation(spark: SparkSession, folder: str) -> DataFrame:
    """The shares per source and condition, and how far they are from the targets."""
    return deviations(*(table(spark, folder, t) for t in ("style_observations", "measured_documents", "split_targets")))


def p5_verified(spark: SparkSession, folder: str) -> DataFrame:
    """Per split, whether its share is within a hundredth of the target, and that no linked set is parted."""
    own = cut(assign_splits(*(table(spark, folder, t) for t in ("style_observations", "measured_documents", "split_targets"))), "assigned")
    parted = own.groupBy("root").agg(F.min("split").alias("low"), F.max("split").alias("high")).where("low <> high").count()
    total = own.count()
    got = own.groupBy("split").agg(F.count("*").alias("n"))
    near = F.abs(F.coalesce("n", F.lit(0)) / F.lit(max(total, 1)) - F.col("share")) <= 0.01
    return table(spark, folder, "split_targets").join(got, "split", "left").select("split", near.alias("near"), F.lit(parted == 0).alias("whole"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the evaluation items they hold."""
    return held_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of an item in a document, with the share of the item found and its place in the original text."""
    return held_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), where=True)


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per evaluation item, how many documents hold it."""
    held = held_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    counts = held.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    items = table(spark, folder, "eval_items").select("item_id", "suite").distinct()
    return items.join(counts, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))


_ONCE = """WITH once AS (
  SELECT lower(trim(source)) AS source, condition, features FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, measured_at) AS rn FROM style_observations) WHERE rn = 1),
vals AS (SELECT source, condition, e.key AS feature_id, e.value AS v FROM (SELECT source, condition, unnest(map_entries(features)) AS e FROM once)
         WHERE e.value IS NOT NULL AND isfinite(e.value)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, condition, feature_id ORDER BY v) AS rn,
                  count(*) OVER (PARTITION BY source, condition, feature_id) AS n FROM vals)"""


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with abusive, hateful or explicit passages."""
    return scores(table(spark, folder, "documents"), table(spark, folder, "review_labels")).where("abusive").select("doc_id")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return scores(table(spark, folder, "documents"), table(spark, folder, "review_labels")).select("doc_id", "score")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of such documents per source."""
    found = scores(table(spark, folder, "documents"), table(spark, folder, "review_labels"))
    return found.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("double")), 9).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    own = (p1_found, p1_report, p1_containment, p1_members, p2_percentiles, p2_from_days, p2_verified, p2_collapsed, p3_found, p3_units, p4_found, p4_pieces, p4_verified, p5_found, p5_assignment, p5_shares, p5_deviation, p5_verified, p6_ids, p7_found, p7_passages, p7_items, p8_found, p8_scores, p8_rates)
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB's form of the queries that SQL can express."""
    percents = ", ".join(f"max(v) FILTER (rn = greatest(1, ({p} * n + 99) // 100)) AS p{p:02d}" for p in PERCENTS)
    exact = f"{_ONCE} SELECT source, condition, feature_id, n, 0::BIGINT AS rank_error, {percents} FROM ranked GROUP BY source, condition, feature_id, n"
    return {
        # Groups of up to 2048 values are never collapsed, so at small scale the sketch is exact.
        "p2_percentiles": exact,
        "p2_from_days": exact,
        "p2_verified": f"{_ONCE} SELECT DISTINCT source, condition, feature_id, n, true AS within_bound FROM ranked",
        "p2_collapsed": f"{_ONCE} SELECT DISTINCT source, condition, feature_id, n, true AS within_bound FROM ranked",
        "p4_verified": """
SELECT p.paper_id, max(length(coalesce(p.text, array_to_string(p.chunks, '')))) AS n_chars, true AS kept
FROM papers p JOIN size_limits s ON s.format = coalesce(lower(trim(p.format)), 'latex')
WHERE length(coalesce(p.text, array_to_string(p.chunks, ''))) > s.max_code_points GROUP BY p.paper_id""",
        "p5_verified": "SELECT split, true AS near, true AS whole FROM split_targets",
        "p4_found": """
SELECT DISTINCT p.paper_id FROM papers p JOIN size_limits s ON s.format = coalesce(lower(trim(p.format)), 'latex')
WHERE length(coalesce(p.text, array_to_string(p.chunks, ''))) > s.max_code_points""",
    }
