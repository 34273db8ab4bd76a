"""Queries of the interval algebra, over ranges derived from each document's length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import surface
from ..sources.tables import table
from .surface import _PARAGRAPHS, _SENTENCES

# All rows take part everywhere; where a rule on ids leaves something out (here and in the other plans) it only makes both outcomes of a check occur.
#: Up to three targets per document: two that touch, one after a gap.
_CUTS = (("0", "n / 5"), ("n / 5", "2 * n / 5"), ("3 * n / 5", "4 * n / 5"))


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "text", F.length("text").cast("long").alias("length"))


def _targets(docs: DataFrame) -> DataFrame:
    cuts = F.array(*(F.struct(F.expr(a.replace("/", "div")).cast("long").alias("start"), F.expr(b.replace("/", "div")).cast("long").alias("end")) for a, b in _CUTS))
    return docs.withColumn("n", F.col("length")).select("doc_id", F.explode(cuts).alias("c")).select("doc_id", "c.*").where("start < end")


def _units(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    text = docs.select("doc_id", "text")
    p = surface.paragraphs(text).select("doc_id", "paragraph", F.col("start_cp").alias("start"), F.col("end_cp").alias("end"), F.col("content_chars").alias("chars"))
    q = surface.sentences(text).select("doc_id", "sentence", "paragraph", F.col("start_cp").alias("start"), F.col("end_cp").alias("end"), F.col("content_chars").alias("chars"))
    return p, q


_SQL_TARGETS = f"""sources AS (SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL),
targets AS ({' UNION ALL '.join(f'SELECT doc_id, {a.replace("/", "//")} AS s, {b.replace("/", "//")} AS e FROM sources WHERE {a.replace("/", "//")} < {b.replace("/", "//")}' for a, b in _CUTS)}),
flagged AS (SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY doc_id ORDER BY s, e) THEN 0 ELSE 1 END AS fresh FROM targets),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS component FROM flagged),
components AS (SELECT doc_id, component::BIGINT AS component, min(s) AS s, max(e) AS e FROM islands GROUP BY 1, 2)"""
_SQL_GAPS = """reach AS (SELECT doc_id, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM targets
  UNION ALL SELECT s.doc_id, coalesce(max(t.e), 0), s.n FROM sources s LEFT JOIN targets t USING (doc_id) GROUP BY s.doc_id, s.n),
gaps AS (SELECT doc_id, a AS "start", b AS "end" FROM reach WHERE a < b)"""
_SELECTED = """met AS (SELECT u.doc_id, u.sentence, u.paragraph, u.start_cp, u.end_cp, u.content_chars AS chars, max(CASE WHEN c.s <= u.start_cp AND u.end_cp <= c.e THEN c.component END) AS component
  FROM sentences u JOIN components c ON u.doc_id = c.doc_id AND u.start_cp < c.e AND c.s < u.end_cp GROUP BY ALL)"""


def _select(spark: SparkSession, d: str) -> DataFrame:
    docs = _sources(spark, d)
    return iv.selected(_units(docs)[1], _targets(docs)).select("doc_id", "sentence", "component", "state")


def _projected(spark: SparkSession, d: str) -> DataFrame:
    docs = _sources(spark, d)
    return iv.projected(*_units(docs), _targets(docs), docs.select("doc_id", "length"))


_SENT = _SENTENCES.removeprefix("WITH ")
_PARA = _PARAGRAPHS.removeprefix("WITH ").replace("lines AS (", "plines AS (", 1).replace("FROM lines", "FROM plines").replace("placed AS", "pplaced AS").replace("FROM placed", "FROM pplaced").replace("kept AS", "pkept AS").replace("FROM kept", "FROM pkept")

QUERIES = {
    "interval_merge": (
        lambda spark, d: iv.components(_targets(_sources(spark, d))),
        f'WITH {_SQL_TARGETS} SELECT doc_id, component, s AS "start", e AS "end" FROM components',
    ),
    "interval_checks": (
        lambda spark, d: iv.invalid(_targets(_sources(spark, d)), _sources(spark, d).select("doc_id", (F.col("length") - 5).alias("length"))),
        f"""WITH {_SQL_TARGETS} SELECT doc_id, count(*) FILTER (t.e > n - 5) AS n_bad FROM targets t JOIN sources USING (doc_id) GROUP BY 1""",
    ),
    "interval_complement": (
        lambda spark, d: iv.gaps(_targets(_sources(spark, d)), _sources(spark, d).select("doc_id", "length")),
        f"WITH {_SQL_TARGETS}, {_SQL_GAPS} SELECT * FROM gaps",
    ),
    "coverage_gaps": (
        lambda spark, d: iv.gaps(
            _targets(_sources(spark, d)).unionByName(_sources(spark, d).select("doc_id", (F.col("length").cast("double") * 0.5).cast("long").alias("start"), F.col("length").alias("end")).where("start < end")),
            _sources(spark, d).select("doc_id", "length"),
        ),
        f"WITH {_SQL_TARGETS.replace('targets AS (', 'targets AS (SELECT doc_id, n // 2 AS s, n AS e FROM sources WHERE n // 2 < n UNION ALL ', 1)}, {_SQL_GAPS} SELECT * FROM gaps",
    ),
    "interval_partition": (
        lambda spark, d: iv.partitions(_targets(_sources(spark, d)), iv.gaps(_targets(_sources(spark, d)), _sources(spark, d).select("doc_id", "length")).where("doc_id % 3 <> 0"), _sources(spark, d).select("doc_id", "length")),
        f"WITH {_SQL_TARGETS}, {_SQL_GAPS} SELECT doc_id, n = 0 OR doc_id % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM gaps g WHERE g.doc_id = s.doc_id) AS is_partition FROM sources s",
    ),
    "unit_selection": (
        _select,
        f"WITH {_SENT}, {_SQL_TARGETS}, {_SELECTED} SELECT doc_id, sentence, component, CASE WHEN component IS NULL THEN 'clipped' ELSE 'complete' END AS state FROM met",
    ),
    "projected_features": (
        _projected,
        f"""WITH {_SENT}, {_PARA}, {_SQL_TARGETS}, {_SELECTED},
pmet AS (SELECT u.doc_id, u.paragraph, u.content_chars AS chars, max(CASE WHEN c.s <= u.start_cp AND u.end_cp <= c.e THEN c.component END) AS component
  FROM paragraphs u JOIN components c ON u.doc_id = c.doc_id AND u.start_cp < c.e AND c.s < u.end_cp GROUP BY ALL),
per_para AS (SELECT doc_id, paragraph, count(*) AS n FROM sentences GROUP BY 1, 2),
pa AS (SELECT doc_id, count(component) AS paragraphs, count(*) - count(component) AS clipped_paragraphs, count(*) FILTER (component IS NOT NULL AND n = 1) AS single, sum(chars) FILTER (component IS NOT NULL) AS pchars
  FROM pmet LEFT JOIN per_para USING (doc_id, paragraph) GROUP BY 1),
sa AS (SELECT doc_id, count(component) AS sentences, count(*) - count(component) AS clipped_sentences, median(chars) FILTER (component IS NOT NULL) AS med,
  quantile_cont(chars::DOUBLE, 0.75) FILTER (component IS NOT NULL) - quantile_cont(chars::DOUBLE, 0.25) FILTER (component IS NOT NULL) AS iqr, quantile_cont(chars::DOUBLE, 0.9) FILTER (component IS NOT NULL) AS q90 FROM met GROUP BY 1),
mads AS (SELECT m.doc_id, median(abs(chars - med)) AS mad FROM met m JOIN sa USING (doc_id) WHERE component IS NOT NULL GROUP BY 1),
nexts AS (SELECT doc_id, content_chars AS a, lead(content_chars) OVER w AS b, start_cp AS s1, lead(end_cp) OVER w AS e1 FROM sentences WINDOW w AS (PARTITION BY doc_id ORDER BY sentence)),
prs AS (SELECT x.doc_id, a, b FROM nexts x JOIN components c ON x.doc_id = c.doc_id AND c.s <= s1 AND e1 <= c.e WHERE b IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY a) + (count(*) OVER (PARTITION BY doc_id, a) - 1) / 2.0 AS x, rank() OVER (PARTITION BY doc_id ORDER BY b) + (count(*) OVER (PARTITION BY doc_id, b) - 1) / 2.0 AS y FROM prs),
ra AS (SELECT doc_id, count(*) AS pairs, avg(abs(a - b)) AS step, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS rho FROM rk GROUP BY 1)
SELECT doc_id, coalesce(paragraphs, 0) AS paragraphs, coalesce(clipped_paragraphs, 0) AS clipped_paragraphs, coalesce(sentences, 0) AS sentences, coalesce(clipped_sentences, 0) AS clipped_sentences, coalesce(pairs, 0) AS pairs,
  CASE WHEN coalesce(clipped_paragraphs, 0) = 0 THEN round(1000.0 * paragraphs / nullif(pchars, 0), 9) + 0.0 END AS f002,
  CASE WHEN coalesce(clipped_paragraphs, 0) = 0 THEN round(single::DOUBLE / nullif(paragraphs, 0), 9) + 0.0 END AS f003,
  CASE WHEN coalesce(clipped_sentences, 0) = 0 THEN round(med, 9) + 0.0 END AS f013, CASE WHEN coalesce(clipped_sentences, 0) = 0 THEN round(iqr, 9) + 0.0 END AS f014,
  CASE WHEN coalesce(clipped_sentences, 0) = 0 THEN round(q90, 9) + 0.0 END AS f015, CASE WHEN coalesce(clipped_sentences, 0) = 0 THEN round(mad / nullif(med, 0), 9) + 0.0 END AS f016,
  CASE WHEN coalesce(clipped_sentences, 0) = 0 THEN round(step / nullif(med, 0), 9) + 0.0 END AS f024, CASE WHEN coalesce(clipped_sentences, 0) = 0 AND pairs >= 3 THEN round(rho, 9) + 0.0 END AS f025
FROM sources LEFT JOIN pa USING (doc_id) LEFT JOIN sa USING (doc_id) LEFT JOIN mads USING (doc_id) LEFT JOIN ra USING (doc_id)""",
    ),
    "projection_counters": (
        lambda spark, d: iv.counters(_units(_sources(spark, d))[1], _targets(_sources(spark, d)), _sources(spark, d).select("doc_id", "length")),
        f"""WITH {_SENT}, {_SQL_TARGETS}, {_SELECTED},
size AS (SELECT doc_id, count(*) AS components, sum(e - s)::BIGINT AS target_codepoints FROM components GROUP BY 1),
st AS (SELECT s.doc_id, s.sentence, m.component, CASE WHEN m.doc_id IS NULL THEN 'excluded' WHEN m.component IS NULL THEN 'clipped' ELSE 'complete' END AS state FROM sentences s LEFT JOIN met m USING (doc_id, sentence)),
nx AS (SELECT doc_id, state AS a, component AS x, lead(state) OVER w AS b, lead(component) OVER w AS y FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY sentence)),
pr AS (SELECT doc_id, count(*) AS pairs, count(*) FILTER (a = 'complete' AND b = 'complete' AND x = y) AS p1, count(*) FILTER (a = 'complete' AND b = 'complete' AND x <> y) AS p2,
  count(*) FILTER (a = 'clipped' OR b = 'clipped') AS p3, count(*) FILTER (NOT (a = 'complete' AND b = 'complete') AND a <> 'clipped' AND b <> 'clipped') AS p4 FROM nx WHERE b IS NOT NULL GROUP BY 1)
SELECT doc_id, n AS source_codepoints, coalesce(target_codepoints, 0) AS target_codepoints, n - coalesce(target_codepoints, 0) AS excluded_codepoints, coalesce(components, 0) AS components, coalesce(pairs, 0) AS pairs,
  coalesce(p1, 0) AS pairs_same_component, coalesce(p2, 0) AS pairs_across_components, coalesce(p3, 0) AS pairs_clipped, coalesce(p4, 0) AS pairs_with_excluded
FROM sources LEFT JOIN size USING (doc_id) LEFT JOIN pr USING (doc_id)""",
    ),
    "projection_digests": (lambda spark, d: iv.target_digests(_sources(spark, d), _targets(_sources(spark, d))), None),
}
