"""Report cards from two fitted tables that must describe the same features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unmatched(train: DataFrame, dev: DataFrame) -> DataFrame:
    """``(feature_id, side)`` of features that only one of the tables has."""
    a, b = train.select("feature_id").distinct(), dev.select("feature_id").distinct()
    return a.join(b, "feature_id", "left_anti").select("feature_id", F.lit("train").alias("side")).unionByName(b.join(a, "feature_id", "left_anti").select("feature_id", F.lit("dev").alias("side")))


def general(train: DataFrame, dev: DataFrame) -> DataFrame:
    """``(feature_id, train, dev, same_sign, line)`` of features supported in both (``feature_id, difference, supported``)."""
    both = train.where("supported").select("feature_id", F.col("difference").alias("train")).join(dev.where("supported").select("feature_id", F.col("difference").alias("dev")), "feature_id")
    line = F.format_string("| %s | %.3f | %.3f |", "feature_id", "train", "dev")
    return both.select("feature_id", "train", "dev", (F.signum("train") == F.signum("dev")).alias("same_sign"), line.alias("line"))


def table_text(rows: DataFrame, title: str) -> str:
    """A Markdown table of card lines; the features of a card are few."""
    lines = [r.line for r in rows.orderBy("feature_id").limit(1000).collect()]
    return "\n".join([f"# {title}", "", "| feature | train | dev |", "|---|---|---|", *lines, ""])
