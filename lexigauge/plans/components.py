"""Queries of the component statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as c
from ..sources.tables import table


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "style_observations")


def significant(x: Column) -> Column:
    """``x`` to eight significant digits, off the ties that engines round apart: sums of doubles differ in the last ones with the order of rows."""
    return F.format_string("%.7e", x * 1.000000000001).cast("double") + 0.0


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.when(F.col(n).isNotNull(), significant(F.col(n))) for n in names})


def _sig(x: str) -> str:
    return f"CAST(printf('%.7e', ({x}) * 1.000000000001) AS DOUBLE) + 0.0"


_ROWS = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, measured_at, component_id, split, source, condition) AS rn FROM style_observations
  WHERE split IN ('TRAIN', 'DEV') AND id IS NOT NULL AND component_id IS NOT NULL AND source IS NOT NULL AND condition IS NOT NULL) WHERE rn = 1),
ex AS (SELECT split, source, condition, component_id, unnest(map_entries(features)) AS e FROM kept),
long AS (SELECT split, source, condition, component_id, e.key AS feature_id, CASE WHEN isfinite(e.value) THEN e.value END AS value FROM ex),
means AS (SELECT split, source, condition, feature_id, component_id, avg(value) AS mean, count(value) AS n, count(*) - count(value) AS missing FROM long GROUP BY ALL)"""
_DIFF = """diffs AS (SELECT h.split, h.source, h.feature_id, h.component_id, h.mean - g.mean AS d FROM means h JOIN means g USING (split, source, feature_id, component_id)
  WHERE h.condition = 'HUMAN' AND g.condition = 'CHATGPT' AND h.mean IS NOT NULL AND g.mean IS NOT NULL)"""

QUERIES = {
    "observation_checks": (
        lambda spark, d: c.checks(_obs(spark, d)),
        """WITH r AS (SELECT count(*) FILTER (schema_tag IS DISTINCT FROM 'style-observation/1') AS schema,
  count(*) FILTER (coalesce(trim(id) = '' OR trim(component_id) = '' OR trim(source) = '' OR trim(condition) = '' OR trim(profile) = '', true)) AS blank_field,
  count(*) FILTER (coalesce(split NOT IN ('TRAIN', 'DEV'), true)) AS split,
  count(*) FILTER (coalesce(list_sort(map_keys(features)) <> list_sort(map_keys(units)), true)) AS units,
  count(*) FILTER (len(list_filter(map_values(features), lambda v: v IS NOT NULL AND NOT isfinite(v))) > 0) AS not_finite,
  greatest(count(DISTINCT profile) - 1, 0) AS extra_profiles FROM style_observations),
x AS (SELECT count(*) AS repeated_id FROM (SELECT id FROM style_observations GROUP BY id HAVING count(*) > 1))
SELECT unnest(['schema', 'blank_field', 'split', 'units', 'not_finite', 'extra_profiles', 'repeated_id']) AS rule, unnest([schema, blank_field, split, units, not_finite, extra_profiles, repeated_id]) AS n FROM r, x""",
    ),
    "split_leakage": (
        lambda spark, d: c.split_leaks(_obs(spark, d)),
        "SELECT component_id, count(DISTINCT split) AS n_splits FROM style_observations WHERE component_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
    ),
    "component_means": (
        lambda spark, d: _rounded(c.component_means(c.long(_obs(spark, d))), "mean"),
        f"WITH {_ROWS} SELECT * REPLACE ({_sig('mean')} AS mean) FROM means",
    ),
    "component_moments": (
        lambda spark, d: _rounded(c.moments(c.long(_obs(spark, d))), "mean", "median", "q10", "q90").drop("missing_documents", "unavailable_components"),
        f"""WITH {_ROWS} SELECT split, source, condition, feature_id, count(mean) AS components, {_sig('avg(mean)')} AS mean, {_sig('quantile_cont(mean, 0.5)')} AS median,
{_sig('quantile_cont(mean, 0.1)')} AS q10, {_sig('quantile_cont(mean, 0.9)')} AS q90 FROM means GROUP BY ALL""",
    ),
    "missing_accounting": (
        lambda spark, d: c.moments(c.long(_obs(spark, d))).select(*c._KEYS, "missing_documents", "unavailable_components"),
        f"WITH {_ROWS} SELECT split, source, condition, feature_id, sum(missing)::BIGINT AS missing_documents, count(*) - count(mean) AS unavailable_components FROM means GROUP BY ALL",
    ),
    "paired_contrast": (
        lambda spark, d: _rounded(c.contrasts(c.long(_obs(spark, d))), "human_minus_chatgpt"),
        f"WITH {_ROWS}, {_DIFF} SELECT split, source, feature_id, count(*) AS paired_components, {_sig('avg(d)')} AS human_minus_chatgpt FROM diffs GROUP BY ALL",
    ),
    "bootstrap_ci": (lambda spark, d: c.bootstrap(c.long(_obs(spark, d))), None),
}
