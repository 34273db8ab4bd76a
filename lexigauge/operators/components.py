"""Statistics of style observations with equal weight for every component."""

from __future__ import annotations

import random
from statistics import fmean

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checks(observations: DataFrame) -> DataFrame:
    """``(rule, n)``: how many rows (or ids, components, profiles) break each rule of an export."""
    per_row = observations.agg(
        F.sum((~F.coalesce(F.col("schema_tag") == "style-observation/1", F.lit(False))).cast("long")).alias("schema"),
        F.sum(F.coalesce((F.trim("id") == "") | (F.trim("component_id") == "") | (F.trim("source") == "") | (F.trim("condition") == "") | (F.trim("profile") == ""), F.lit(True)).cast("long")).alias("blank_field"),
        F.sum((~F.coalesce(F.col("split").isin("TRAIN", "DEV"), F.lit(False))).cast("long")).alias("split"),
        F.sum((~F.coalesce(F.array_sort(F.map_keys("features")) == F.array_sort(F.map_keys("units")), F.lit(False))).cast("long")).alias("units"),
        F.sum((~F.coalesce(F.forall(F.map_values("features"), lambda v: v.isNull() | (~F.isnan(v) & (F.abs(v) < float("inf")))), F.lit(True))).cast("long")).alias("not_finite"),
        F.greatest(F.countDistinct("profile") - 1, F.lit(0)).alias("extra_profiles"),
    )
    repeated = observations.groupBy("id").count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0)).alias("repeated_id"))
    wide = per_row.crossJoin(repeated)
    names = ["schema", "blank_field", "split", "units", "not_finite", "extra_profiles", "repeated_id"]
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n")) for n in names))).alias("r")).select("r.*")


def split_leaks(observations: DataFrame) -> DataFrame:
    """``(component_id, n_splits)``: components in more than one split (as written)."""
    return observations.groupBy("component_id").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1 and component_id is not null")


def long(observations: DataFrame) -> DataFrame:
    """Finite or null values of any magnitude, one row per TRAIN or DEV observation and feature; incomplete rows are left out, non-finite values are null."""
    whole = observations.where("split in ('TRAIN', 'DEV') and id is not null and component_id is not null and source is not null and condition is not null")
    kept = whole.groupBy("id").agg(F.min_by(F.struct("split", "source", "condition", "component_id", "features"), F.struct("received_at", "measured_at", "component_id", "split", "source", "condition")).alias("r")).select("r.*")
    rows = kept.select("split", "source", "condition", "component_id", F.explode("features").alias("feature_id", "value"))
    return rows.withColumn("value", F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value")))


_KEYS = ["split", "source", "condition", "feature_id"]


def component_means(rows: DataFrame) -> DataFrame:
    """``(split, source, condition, feature_id, component_id, mean, n, missing)``; a component without value has a null mean."""
    return rows.groupBy(*_KEYS, "component_id").agg(F.avg("value").alias("mean"), F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("missing"))


def moments(rows: DataFrame) -> DataFrame:
    """Moments over component means, each component once, with what is missing."""
    means = component_means(rows)
    q = F.percentile("mean", [0.1, 0.5, 0.9])
    stats = means.groupBy(*_KEYS).agg(
        F.count("mean").alias("components"), F.avg("mean").alias("mean"), q.alias("q"),
        F.sum("missing").alias("missing_documents"), F.sum(F.col("mean").isNull().cast("long")).alias("unavailable_components"),
    )
    return stats.select(*_KEYS, "components", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q10"), F.col("q")[2].alias("q90"), "missing_documents", "unavailable_components")


def differences(rows: DataFrame) -> DataFrame:
    """``(split, source, feature_id, component_id, d)``: HUMAN minus CHATGPT where a component has both."""
    means = component_means(rows).where("mean is not null and condition in ('HUMAN', 'CHATGPT')")
    keys = ["split", "source", "feature_id", "component_id"]
    both = means.groupBy(*keys).agg(F.max(F.when(F.col("condition") == "HUMAN", F.col("mean"))).alias("h"), F.max(F.when(F.col("condition") == "CHATGPT", F.col("mean"))).alias("g"))
    return both.where("h is not null and g is not null").select(*keys, (F.col("h") - F.col("g")).alias("d"))


def contrasts(rows: DataFrame) -> DataFrame:
    """``(split, source, feature_id, paired_components, human_minus_chatgpt)``."""
    return differences(rows).groupBy("split", "source", "feature_id").agg(F.count("*").alias("paired_components"), F.avg("d").alias("human_minus_chatgpt"))


def bootstrap(rows: DataFrame, draws: int = 400, seed: int = 0) -> DataFrame:
    """``(split, source, feature_id, low, high)``: the 95 % interval of the mean difference.

    Differences are resampled in component order by a generator seeded with
    "seed/split/source/feature", by the same rule at every size. The keys are few; a key's
    differences, one number a component, are in one task.
    """
    if not isinstance(draws, int) or isinstance(draws, bool) or not 0 <= draws <= 10_000:
        raise ValueError("draws must be an integer between 0 and 10000")
    keys = ["split", "source", "feature_id"]

    def resampled(frame: pd.DataFrame) -> pd.DataFrame:
        key = tuple(frame[k].iloc[0] for k in keys)
        if not draws or len(frame) < 2:
            return pd.DataFrame([], columns=[*keys, "low", "high"])
        rng = random.Random("/".join([str(seed), *key]))
        values = frame.sort_values("component_id")["d"].tolist()
        means = [fmean(rng.choices(values, k=len(values))) for _ in range(draws)]
        return pd.DataFrame([(*key, float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)))], columns=[*keys, "low", "high"])

    return differences(rows).groupBy(*keys).applyInPandas(resampled, "split string, source string, feature_id string, low double, high double")
