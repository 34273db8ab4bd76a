"""Commands over files: each prints JSON lines; exit code 2 tells of blockers or errors."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import components, editorial, papers, surface
from .sources import files

_OBSERVATION = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("schema", "id", "component_id", "source", "condition", "split", "profile")),
    T.StructField("units", T.MapType(T.StringType(), T.StringType())), T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
])


def analyze(spark: SparkSession, path: str) -> DataFrame:
    """Surface features of the files under ``path``, keyed by the hash of their bytes."""
    return surface.features_long(files.raw_texts(spark, path).select(F.col("sha256").alias("doc_id"), "text"))


def summarize(spark: SparkSession, path: str) -> DataFrame:
    """Moments of observations in JSON lines."""
    rows = files.json_lines(spark, path, _OBSERVATION)
    return components.moments(components.long(rows.withColumns({"received_at": F.lit(0), "measured_at": F.lit(0)})))


def check(spark: SparkSession, original: str, candidate: str) -> DataFrame:
    """What differs between two versions of one file."""
    a, b = (files.raw_texts(spark, p).select(F.lit(1).alias("pair_id"), F.col("text").alias(n)) for p, n in ((original, "original"), (candidate, "candidate")))
    return editorial.review(a.join(b, "pair_id"))


def read_paper(spark: SparkSession, path: str) -> DataFrame:
    """The structure of the papers under ``path``."""
    return papers.parsed(files.formats(files.raw_texts(spark, path)).select(F.col("sha256").alias("paper_id"), "format", "text"))


def main(args: list[str] | None = None) -> int:
    commands = {"analyze": (analyze, 1), "summarize": (summarize, 1), "check": (check, 2), "read-paper": (read_paper, 1)}
    parser = argparse.ArgumentParser(prog="lexigauge")
    parser.add_argument("command", choices=commands)
    parser.add_argument("paths", nargs="+")
    given = parser.parse_args(args)
    command, count = commands[given.command]
    if len(given.paths) != count:
        parser.error(f"{given.command} takes {count} path(s)")
    spark = SparkSession.builder.getOrCreate()
    blocked = False
    for line in command(spark, *given.paths).toJSON().toLocalIterator():
        print(line)
        blocked |= "BLOCKED_PROTECTED_CHANGE" in line
    return 2 if blocked else 0


if __name__ == "__main__":
    sys.exit(main())
