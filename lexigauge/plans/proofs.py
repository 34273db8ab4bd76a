"""Queries of the proof-graph operators.

Papers carry no annotations, so the graphs are derived: the documents of a source, 500 to a graph and in order, rest on earlier ones by a fixed rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import proofs as g
from ..sources.tables import table

_KINDS = ("theorem", "lemma", "definition", "remark", "proposition")


def _pick(values: tuple[str, ...], at: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), F.expr(f"cast({at} as int)") + 1)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("source is not null").select("source", "doc_id")
    row = (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long")
    rows = docs.select("source", row.alias("row")).select(F.when(F.col("row") < 500, F.col("source")).otherwise(F.concat("source", F.lit("#"), F.expr("row div 500"))).alias("graph"), F.expr("row % 500").alias("pos"))
    return rows.select("graph", F.concat(F.lit("n"), F.col("pos")).alias("node"), "pos", _pick(_KINDS, "pos % 5").alias("kind"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("pos > 0 and pos % 7 <> 0")
    rules = F.explode(F.array(F.expr("pos div 2"), F.expr("pos div 3"))).alias("from")
    rows = n.select("graph", "pos", rules).where("from < pos").distinct()
    kind = F.when(F.col("pos") % 11 == 0, "guess").otherwise("application")
    role = F.when(F.col("pos") % 13 == 0, " ").otherwise("used")
    basis = F.when(F.col("pos") % 17 == 0, "explicit").when(F.col("pos") % 2 == 0, "reconstruction").otherwise("explicit_source")
    return rows.select("graph", F.concat(F.lit("n"), "from").alias("src"), F.concat(F.lit("n"), "pos").alias("dst"), kind.alias("kind"), role.alias("role"), basis.alias("basis"), (-F.col("from")).alias("pos"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("pos % 10 = 5").select("graph", "node")


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("pos div 5 % 6 <> 4")
    note = F.when(F.col("pos") % 3 == 0, "seen").when(F.col("pos") % 3 == 1, " ")
    return n.select("graph", "node", _pick(("reviewed", "assumed", "gap", "checked", "", "reviewed"), "pos div 5 % 6").alias("status"), note.alias("note"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ev = F.transform(F.sequence(F.lit(0), (i % 4).cast("int")), lambda k: F.struct((k % 2 == 1).alias("external")))
    named = F.when(i % 23 == 0, F.array().cast("array<string>")).when(i % 19 == 0, F.array(F.lit("n0"), F.lit("x"))).otherwise(F.array(F.lit("n0")))
    return table(spark, d, "documents").where("source is not null").select(
        F.col("source").alias("graph"), i.alias("claim_id"), _pick(("guess", *g.CLAIMS), "doc_id % 8").alias("kind"), F.when(i % 17 == 0, " ").otherwise("text").alias("text"), named.alias("nodes"),
        _pick((*g.CLAIM_BASES, "explicit"), "doc_id % 4").alias("basis"), F.when(i % 5 == 0, F.slice(ev, 1, 0)).otherwise(ev).alias("evidence"),
    )


def _arguments(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("pos % 10 = 5 and pos div 10 % 5 <> 0")
    part = lambda k: F.struct(F.when(F.col("pos") % k == 0, " ").otherwise("why").alias("text"), F.when(F.col("pos") % (k + 1) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("evidence"))
    return n.select(
        "graph", "node", F.when(F.col("pos") % 25 != 0, "a").alias("statement"), F.lit("a").alias("conclusion"), F.when(F.col("pos") % 35 != 0, F.array(F.lit("a"))).alias("hypotheses"),
        part(9).alias("obstruction"), part(11).alias("mechanism"), part(13).alias("idea"), _pick(("reviewed", "unresolved", "done", "reviewed", "unresolved"), "pos div 10 % 5").alias("status"),
    )


def _readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("graph"), F.length("text").cast("long").alias("length")).where("length > 20 and graph % 3 < 2")
    part = F.explode(F.when(F.col("graph") % 3 == 0, F.array(F.struct(F.lit(0).alias("a"), F.lit(12).alias("b")), F.struct(F.lit(9).alias("a"), F.col("length").alias("b")))).otherwise(
        F.array(F.struct(F.lit(5).alias("a"), F.lit(9).alias("b")), F.struct(F.lit(6).alias("a"), F.lit(8).alias("b")), F.struct(F.lit(15).alias("a"), F.col("length").cast("long").alias("b")))))
    return docs.select("graph", part.alias("x")).select("graph", F.col("x.a").cast("long").alias("start"), F.col("x.b").cast("long").alias("end")), docs


def _manual(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    node = F.when(F.col("pos") % 6 == 0, F.col("node")).when(F.col("pos") % 6 == 1, "").otherwise(F.concat(F.lit("m"), F.expr("pos div 2")))
    return n.where("pos % 4 <> 3").select("graph", node.alias("node"), "pos", _pick((*g.MANUAL_KINDS, "remark"), "pos % 8").alias("kind"))


_TEXT = "a draft that the five checks quote"


def _receipts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id")
    current = docs.where("doc_id % 31 <> 0").select(i.alias("graph"), i.cast("string").alias("document_id"), F.lit(_TEXT).alias("candidate"), F.sha2(F.concat(F.lit("r"), i), 256).alias("reconstruction_sha256"))
    names = F.array(*map(F.lit, g.REVIEW_CHECKS))
    names = F.when(i % 13 == 0, F.concat(F.slice(names, 1, 4), F.array(F.lit("scope2")))).when(i % 13 == 1, F.slice(names, 1, 4)).otherwise(names)
    status = F.when(i % 11 == 0, "uncertain").when(i % 11 == 1, "fail").otherwise("pass")
    check = lambda n: F.struct(
        n.alias("id"), status.alias("status"), F.lit(2).alias("start"), F.when(i % 17 == 0, 99).otherwise(7).alias("end"), F.when(i % 19 == 0, "drift").otherwise("draft").alias("quote"),
        F.when(i % 23 == 0, " ").otherwise("why").alias("reason"), F.when(i % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("evidence"),
    )
    reviews = docs.select(
        i.alias("graph"), F.when(i % 7 == 0, "0").otherwise(i.cast("string")).alias("document_id"), F.sha2(F.when(i % 7 == 1, "old").otherwise(_TEXT), 256).alias("candidate_sha256"),
        F.sha2(F.concat(F.when(i % 7 == 2, "old").otherwise("r"), i), 256).alias("reconstruction_sha256"), F.transform(names, check).alias("checks"),
    )
    return reviews, current


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id")
    graphs = docs.where("doc_id % 10 <> 9").select(F.col("doc_id").alias("graph"), F.col("doc_id").cast("string").alias("document_id"))
    own = F.explode(F.array(F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).otherwise(-1), F.lit(-1), F.when(F.col("doc_id") % 3 == 0, F.lit(-1)).otherwise(F.lit(-2)), F.lit(-3)))
    return docs.select(F.col("doc_id").alias("graph"), own.alias("x")).where("x <> -1 or graph % 5 < 2").select("graph", F.col("x").cast("string").alias("document_id")), graphs


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    start, end = F.expr("length(text) div 3"), F.expr("length(text) div 3 + 10")
    quote = F.when(F.col("doc_id") % 7 == 0, F.lit("not there")).otherwise(F.substr("text", start + 1, F.lit(10)))
    return docs.select(F.col("doc_id").alias("anchor_id"), F.when(F.col("doc_id") % 9 == 0, -1).otherwise(F.col("doc_id")).alias("doc_id"), start.cast("long").alias("start"), end.cast("long").alias("end"), quote.alias("quote"))


def _needed(spark: SparkSession, d: str) -> DataFrame:
    return g.closure(_targets(spark, d), _edges(spark, d))


def _gate(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    graphs = n.select("graph").distinct()
    findings = g.coverage_findings(_needed(spark, d), n, _edges(spark, d), _coverage(spark, d))
    checks = n.where("pos < 5").select("graph", _pick(g.REVIEW_CHECKS, "pos").alias("check"), F.when((F.col("pos") == 4) & F.col("graph").like("%7"), "fail").otherwise("pass").alias("status"))
    return g.gate(findings, n.where("pos = 2 and graph like '%3'"), checks, graphs)


_NODES = """rows AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents WHERE source IS NOT NULL),
nodes AS (SELECT CASE WHEN r < 500 THEN source ELSE source || '#' || (r // 500) END AS graph, r % 500 AS pos FROM rows),
edges AS (SELECT DISTINCT graph, f AS src, pos AS dst FROM (SELECT graph, pos, unnest([pos // 2, pos // 3]) AS f FROM nodes WHERE pos > 0 AND pos % 7 <> 0) WHERE f < pos)"""
_CLOSURE = f"""WITH RECURSIVE {_NODES}, needed AS (SELECT graph, pos FROM nodes WHERE pos % 10 = 5 UNION SELECT e.graph, e.src FROM needed n JOIN edges e ON e.graph = n.graph AND e.dst = n.pos)"""
_FOUND = """found AS (SELECT * FROM (SELECT graph, pos, CASE WHEN pos // 5 % 6 IN (3, 4) THEN 'missing_proof_review' WHEN pos // 5 % 6 = 1 THEN 'proof_assumed' WHEN pos // 5 % 6 = 2 THEN 'proof_gap'
  WHEN pos % 5 <> 2 AND pos % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = needed.graph AND e.dst = needed.pos) THEN 'leaf_result_needs_review' END AS finding FROM needed) WHERE finding IS NOT NULL)"""
_CLAIMS = """c AS (SELECT source AS graph, doc_id AS claim_id, doc_id % 8 AS k, doc_id % 4 AS b, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 4 + 1 END AS n FROM documents WHERE source IS NOT NULL)"""
# Kinds 1 and 3 and 7 are who or what brought an idea about, 3 the historical origin; basis 0 is an explicit source, 2 is unverified.
_CLAIM_FOUND = """cf AS (SELECT graph, claim_id, unnest(list_filter([CASE WHEN k IN (1, 3, 7) AND b <> 0 THEN 'unsupported_attribution' END, CASE WHEN k = 3 AND n < 2 THEN 'primary_source_not_checked' END,
  CASE WHEN b = 2 THEN 'unverified_claim' END], lambda v: v IS NOT NULL)) AS finding FROM c)"""
_ARGUED = """af AS (SELECT graph, pos, CASE WHEN pos // 10 % 5 = 0 THEN 'missing_argument_record' ELSE 'unresolved_argument' END AS finding FROM nodes WHERE pos % 10 = 5 AND pos // 10 % 5 IN (0, 1, 4))"""


def _all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every open finding of every graph: coverage, claims and arguments."""
    n = _nodes(spark, d)
    found = g.coverage_findings(_needed(spark, d), n, _edges(spark, d), _coverage(spark, d)).select("graph", "finding", F.col("node").alias("about"))
    claims = g.claim_findings(_claims(spark, d)).select("graph", "finding", F.col("claim_id").cast("string").alias("about"))
    arguments = g.argument_findings(_targets(spark, d), _arguments(spark, d)).select("graph", "finding", F.col("node").alias("about"))
    return found.unionByName(claims).unionByName(arguments)


def _reconstructed(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return g.reconstructions(n.select("graph").distinct(), g.ordered(n, _edges(spark, d)), _needed(spark, d), _all_findings(spark, d))


QUERIES = {
    "evidence_check": (
        lambda spark, d: g.evidence(_anchors(spark, d), table(spark, d, "documents")),
        """SELECT doc_id AS anchor_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown_document' WHEN length(text) // 3 + 10 > length(text) THEN 'offsets' WHEN doc_id % 7 = 0 THEN 'quote' END AS problem FROM documents WHERE text IS NOT NULL""",
    ),
    "edge_check": (
        lambda spark, d: g.edge_problems(_nodes(spark, d), _edges(spark, d)),
        f"WITH {_NODES} SELECT graph, 'n' || src AS src, 'n' || dst AS dst, CASE WHEN dst % 11 = 0 THEN 'kind' WHEN dst % 13 = 0 THEN 'role' ELSE 'basis' END AS problem FROM edges WHERE dst % 11 = 0 OR dst % 13 = 0 OR dst % 17 = 0",
    ),
    "target_check": (
        lambda spark, d: g.target_problems(_nodes(spark, d).where("pos % 3 = 0").select("graph", F.when(F.col("pos") % 2 == 0, F.col("node")).otherwise(F.concat("node", F.lit("x"))).alias("node")), _nodes(spark, d)),
        f"WITH {_NODES} SELECT graph, CASE WHEN pos % 2 = 0 THEN 'n' || pos ELSE 'n' || pos || 'x' END AS node, CASE WHEN pos % 2 = 0 THEN 'kind' ELSE 'unknown_node' END AS problem FROM nodes WHERE pos % 3 = 0 AND (pos % 2 = 1 OR pos % 5 IN (2, 3))",
    ),
    "ancestor_closure": (_needed, f"{_CLOSURE} SELECT graph, 'n' || pos AS node FROM needed"),
    "topological_order": (lambda spark, d: g.ordered(_nodes(spark, d), _edges(spark, d)), None),
    "topological_check": (
        lambda spark, d: _edges(spark, d).join(g.ordered(_nodes(spark, d), _edges(spark, d)).select("graph", F.col("node").alias("src"), F.col("place").alias("a")), ["graph", "src"])
        .join(g.ordered(_nodes(spark, d), _edges(spark, d)).select("graph", F.col("node").alias("dst"), F.col("place").alias("b")), ["graph", "dst"])
        .groupBy("graph").agg(F.count("*").alias("n_edges"), F.min(F.col("a") < F.col("b")).alias("in_order")),
        f"WITH {_NODES} SELECT graph, count(*) AS n_edges, true AS in_order FROM edges GROUP BY 1",
    ),
    "topological_cycles": (
        lambda spark, d: g.cycles(g.ordered(_nodes(spark, d), _edges(spark, d).unionByName(_nodes(spark, d).where("pos = 6").select("graph", F.col("node").alias("src"), F.lit("n1").alias("dst"), F.lit("application").alias("kind"), F.lit("used").alias("role"), F.lit("reconstruction").alias("basis"), F.lit(0).cast("long").alias("pos"))))),
        f"WITH RECURSIVE {_NODES}, stuck AS (SELECT graph, 1 AS pos FROM nodes WHERE pos = 6 UNION SELECT e.graph, e.dst FROM stuck s JOIN edges e ON e.graph = s.graph AND e.src = s.pos) SELECT graph, count(*) AS n_nodes FROM stuck GROUP BY 1",
    ),
    "source_problems": (
        lambda spark, d: g.source_problems(*_sources(spark, d)),
        """WITH s AS (SELECT doc_id AS graph, unnest([CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE -1 END, -1, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE -2 END, -3]) AS x FROM documents),
k AS (SELECT graph, x, count(*) AS n FROM s WHERE x <> -1 OR graph % 5 < 2 GROUP BY 1, 2)
SELECT graph, x::VARCHAR AS document_id, CASE WHEN graph % 10 = 9 THEN 'unknown_graph' ELSE 'duplicate' END AS problem FROM k WHERE graph % 10 = 9 OR n > 1 OR x = graph""",
    ),
    "manual_nodes": (
        lambda spark, d: g.with_manual(_nodes(spark, d), _manual(spark, d)),
        f"""WITH {_NODES}, m AS (SELECT graph, pos, CASE pos % 6 WHEN 0 THEN 'n' || pos WHEN 1 THEN '' ELSE 'm' || (pos // 2) END AS node, (['assumption', 'definition', 'theorem', 'lemma', 'proposition', 'external_result', 'proof', 'remark'])[pos % 8 + 1] AS kind
FROM nodes WHERE pos % 4 <> 3), k AS (SELECT *, count(*) OVER (PARTITION BY graph, node) AS n FROM m), b AS (SELECT graph, max(pos) + 1 AS base FROM nodes GROUP BY 1)
SELECT graph, 'n' || pos AS node, pos, (['theorem', 'lemma', 'definition', 'remark', 'proposition'])[pos % 5 + 1] AS kind FROM nodes
UNION ALL SELECT graph, node, pos + base, kind FROM k JOIN b USING (graph) WHERE node <> '' AND node NOT LIKE 'n%' AND n = 1 AND kind <> 'remark'""",
    ),
    "manual_problems": (
        lambda spark, d: g.manual_problems(_manual(spark, d), _nodes(spark, d)),
        f"""WITH {_NODES}, m AS (SELECT graph, pos, CASE pos % 6 WHEN 0 THEN 'n' || pos WHEN 1 THEN '' ELSE 'm' || (pos // 2) END AS node FROM nodes WHERE pos % 4 <> 3),
k AS (SELECT graph, node, count(*) AS n, bool_or(pos % 8 = 7) AS odd FROM m GROUP BY 1, 2)
SELECT graph, node, CASE WHEN node = '' THEN 'invalid_id' WHEN node LIKE 'n%' OR n > 1 THEN 'duplicate_id' ELSE 'kind' END AS problem FROM k WHERE node = '' OR node LIKE 'n%' OR n > 1 OR odd""",
    ),
    "claim_problems": (
        lambda spark, d: g.claim_problems(_claims(spark, d), _nodes(spark, d)),
        """WITH p AS (SELECT source AS graph, doc_id AS claim_id, CASE WHEN doc_id % 8 = 0 OR doc_id % 17 = 0 THEN 'kind_or_text' WHEN doc_id % 23 = 0 OR doc_id % 19 = 0 THEN 'nodes'
  WHEN doc_id % 5 = 0 THEN 'evidence' WHEN doc_id % 4 = 3 THEN 'basis' END AS problem FROM documents WHERE source IS NOT NULL) SELECT * FROM p WHERE problem IS NOT NULL""",
    ),
    "claim_findings": (lambda spark, d: g.claim_findings(_claims(spark, d)), f"WITH {_CLAIMS}, {_CLAIM_FOUND} SELECT * FROM cf"),
    "argument_problems": (
        lambda spark, d: g.argument_problems(_arguments(spark, d)),
        f"""WITH {_NODES}, p AS (SELECT graph, 'n' || pos AS node, CASE WHEN pos % 25 = 0 THEN 'anchor' WHEN pos % 35 = 0 THEN 'hypotheses' WHEN pos % 9 = 0 THEN 'obstruction' WHEN pos % 10 = 0 THEN 'obstruction_evidence'
  WHEN pos % 11 = 0 THEN 'mechanism' WHEN pos % 12 = 0 THEN 'mechanism_evidence' WHEN pos % 13 = 0 THEN 'idea' WHEN pos % 14 = 0 THEN 'idea_evidence' WHEN pos // 10 % 5 = 2 THEN 'status' END AS problem
FROM nodes WHERE pos % 10 = 5 AND pos // 10 % 5 <> 0) SELECT * FROM p WHERE problem IS NOT NULL""",
    ),
    "argument_findings": (lambda spark, d: g.argument_findings(_targets(spark, d), _arguments(spark, d)), f"WITH {_NODES}, {_ARGUED} SELECT graph, 'n' || pos AS node, finding FROM af"),
    "reading_findings": (
        lambda spark, d: g.reading_findings(*_readings(spark, d)),
        """WITH t AS (SELECT doc_id AS graph FROM documents WHERE length(text) > 20 AND doc_id % 3 = 1) SELECT graph, unnest([0, 9]) AS start, unnest([5, 15]) AS "end" FROM t""",
    ),
    "coverage_findings": (
        lambda spark, d: g.coverage_findings(_needed(spark, d), _nodes(spark, d), _edges(spark, d), _coverage(spark, d)),
        f"{_CLOSURE}, {_FOUND} SELECT graph, 'n' || pos AS node, finding FROM found",
    ),
    "reconstruction": (
        lambda spark, d: _reconstructed(spark, d).select("graph", F.size("prerequisite_order").alias("n_needed"), F.size("excluded").alias("n_excluded"), F.transform("findings", lambda x: F.concat_ws(":", x["finding"], x["about"])).alias("findings")),
        f"""{_CLOSURE}, {_FOUND}, {_CLAIMS}, {_CLAIM_FOUND}, {_ARGUED},
every AS (SELECT graph, finding, 'n' || pos AS about FROM found UNION ALL SELECT graph, finding, claim_id::VARCHAR FROM cf UNION ALL SELECT graph, finding, 'n' || pos FROM af),
k AS (SELECT graph, count(*) AS n FROM needed GROUP BY 1), l AS (SELECT graph, list(finding || ':' || about ORDER BY finding, about) AS findings FROM every GROUP BY 1), s AS (SELECT graph, count(*) AS n FROM nodes GROUP BY 1)
SELECT s.graph, coalesce(k.n, 0)::INT AS n_needed, (s.n - coalesce(k.n, 0))::INT AS n_excluded, coalesce(l.findings, []) AS findings FROM s LEFT JOIN k USING (graph) LEFT JOIN l USING (graph)""",
    ),
    "reconstruction_hash": (lambda spark, d: _reconstructed(spark, d).select("graph", "prerequisite_order", "reconstruction_sha256"), None),
    "receipt_problems": (
        lambda spark, d: g.receipt_problems(*_receipts(spark, d)),
        """WITH p AS (SELECT doc_id AS graph, CASE WHEN doc_id % 31 = 0 THEN 'unknown_graph' WHEN doc_id % 7 IN (0, 1) AND doc_id <> 0 THEN 'stale_candidate' WHEN doc_id % 7 = 2 THEN 'stale_reconstruction' WHEN doc_id % 13 IN (0, 1) THEN 'checks'
  WHEN doc_id % 29 = 0 THEN 'evidence' WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 THEN 'quote_or_reason' WHEN doc_id % 11 = 0 THEN 'status' END AS problem FROM documents WHERE text IS NOT NULL)
SELECT * FROM p WHERE problem IS NOT NULL""",
    ),
    "receipts_accepted": (
        lambda spark, d: g.accepted(*_receipts(spark, d)),
        """SELECT doc_id AS graph, NOT (doc_id % 7 IN (0, 1, 2) OR doc_id % 13 IN (0, 1) OR doc_id % 29 = 0 OR doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 23 = 0 OR doc_id % 11 IN (0, 1)) AS accepted
FROM documents WHERE text IS NOT NULL AND doc_id % 31 <> 0""",
    ),
    "audit_gate": (
        _gate,
        f"""{_CLOSURE}, {_FOUND}, f AS (SELECT graph, count(*) AS n FROM found GROUP BY 1), s AS (SELECT graph, count(*) AS n FROM nodes GROUP BY 1)
SELECT s.graph, coalesce(f.n, 0) = 0 AND NOT (s.n > 2 AND s.graph LIKE '%3') AND s.n >= 5 AND s.graph NOT LIKE '%7' AS allowed, coalesce(f.n, 0) AS n_findings, (s.n > 2 AND s.graph LIKE '%3')::BIGINT AS n_blockers,
  least(s.n, 5) - (s.n >= 5 AND s.graph LIKE '%7')::BIGINT AS n_passed FROM s LEFT JOIN f USING (graph)""",
    ),
    "explanation_order": (
        lambda spark, d: g.explanation_order(g.ordered(_nodes(spark, d), _edges(spark, d)), _needed(spark, d), _nodes(spark, d).where("pos % 6 = 1")),
        None,
    ),
    "explanation_nodes": (
        lambda spark, d: g.explanation_order(g.ordered(_nodes(spark, d), _edges(spark, d)), _needed(spark, d), _nodes(spark, d).where("pos % 6 = 1")).select("graph", "node"),
        f"{_CLOSURE} SELECT graph, 'n' || pos AS node FROM needed WHERE pos % 6 <> 1",
    ),
}
