"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The modules of ``plans``; each holds QUERIES: name -> (query, SQL or None).
PLANS = ("surface", "intervals", "components", "english", "editorial", "papers", "proofs", "channels", "sources")


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out = {}
    for name in PLANS:
        out.update(importlib.import_module(f"{__package__}.plans.{name}").QUERIES)
    return out


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The surface features of every document."""
    return queries()["surface_features_long"](spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query by name."""
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """SQL by name of query, where SQL can express it."""
    return {name: sql for name, (_, sql) in _all().items() if sql}
