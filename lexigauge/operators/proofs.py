"""Proof graphs: evidence, dependency order, closure and open findings. Nothing here certifies a proof.

A graph is ``nodes (graph, node, pos, kind)`` and ``edges (graph, src, dst, kind, role, basis[, pos])``.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

# Kinds of relation, of claim and of target, and what a statement may rest on.
RELATIONS = ("construction", "reduction", "estimate", "contradiction", "local_to_global", "necessity", "sufficiency", "application", "definition")
CLAIMS = ("author_motivation", "mathematical_motivation", "historical_origin", "method_difference", "limitation", "transferable_idea", "innovation")
TARGETS = ("theorem", "proposition", "lemma", "external_result")
BASES = ("explicit_source", "reconstruction")
CLAIM_BASES = (*BASES, "unverified")
MANUAL_KINDS = ("assumption", "definition", "theorem", "lemma", "proposition", "external_result", "proof")
ATTRIBUTIONS = ("author_motivation", "historical_origin", "innovation")
GIVEN = ("definition", "assumption", "external_result")
#: Nodes of a graph that one task orders.
MOST_NODES = 50_000


def evidence(anchors: DataFrame, documents: DataFrame) -> DataFrame:
    """``(anchor_id, problem)``: null if the quote stands exactly there, else what is wrong."""
    texts = documents.select(F.col("doc_id"), F.col("text")).where("text is not null")
    both = anchors.join(texts, "doc_id", "left")
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    exact = F.substr("text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).eqNullSafe(F.col("quote"))
    problem = F.when(F.col("text").isNull(), "unknown_document").when(~F.coalesce(inside, F.lit(False)), "offsets").when(~exact, "quote")
    return both.select("anchor_id", problem.alias("problem"))


def edge_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph, src, dst, problem)`` of every edge that breaks a rule (the first that it breaks)."""
    known = nodes.select("graph", "node").distinct()
    ends = edges.join(known.select("graph", F.col("node").alias("src"), F.lit(True).alias("has_src")), ["graph", "src"], "left").join(known.select("graph", F.col("node").alias("dst"), F.lit(True).alias("has_dst")), ["graph", "dst"], "left")
    again = edges.groupBy("graph", "src", "dst").agg(F.count("*").alias("n"))
    rows = ends.join(again, ["graph", "src", "dst"])
    problem = (
        F.when(F.col("has_src").isNull() | F.col("has_dst").isNull(), "unknown_node").when(F.col("src") == F.col("dst"), "self")
        .when(F.col("n") > 1, "duplicate").when(~F.coalesce(F.col("kind").isin(*RELATIONS), F.lit(False)), "kind")
        .when(F.coalesce(F.trim("role"), F.lit("")) == "", "role").when(~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)), "basis")
    )
    return rows.select("graph", "src", "dst", problem.alias("problem")).where("problem is not null")


def target_problems(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph, node, problem)`` of targets that are unknown or not of a kind that is proved."""
    both = targets.select("graph", "node").distinct().join(nodes.select("graph", "node", "kind"), ["graph", "node"], "left")
    problem = F.when(F.col("kind").isNull(), "unknown_node").when(~F.col("kind").isin(*TARGETS), "kind")
    return both.select("graph", "node", problem.alias("problem")).where("problem is not null")


def ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph, node, place)``: prerequisites first, by arrival; nodes on or behind a cycle have a null place (see :func:`cycles`).

    What a node leads to arrives in the order of the edges (``pos`` where there is one, else the order of nodes). One task orders one graph, which may have at most ``MOST_NODES`` nodes.
    """
    pos = F.min("pos") if "pos" in edges.columns else F.min(F.lit(0))
    links = edges.groupBy("graph", "src", "dst").agg(pos.alias("at"))
    kind = nodes.schema["graph"].dataType.simpleString()

    def run(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if len(n) > MOST_NODES:
            raise ValueError(f"a graph has more than {MOST_NODES} nodes")
        n = n.sort_values(["pos", "node"])
        waiting = dict.fromkeys(n["node"], 0)
        after: dict[str, list[str]] = {}
        rank = {x: i for i, x in enumerate(waiting)}
        for _, _, a, b in sorted((at, rank[b], a, b) for a, b, at in zip(e["src"], e["dst"], e["at"]) if a in rank and b in rank):
            waiting[b] += 1
            after.setdefault(a, []).append(b)
        ready, place = deque(x for x, k in waiting.items() if not k), {}
        while ready:
            x = ready.popleft()
            place[x] = len(place)
            for y in after.get(x, ()):
                waiting[y] -= 1
                if not waiting[y]:
                    ready.append(y)
        out = pd.DataFrame({"graph": n["graph"], "node": n["node"], "place": [place.get(x) for x in n["node"]]})
        return out.astype({"place": "Int64"})

    left, right = nodes.select("graph", "node", "pos"), links.select(F.col("graph").alias("g"), "src", "dst", "at")
    return left.groupBy("graph").cogroup(right.groupBy("g")).applyInPandas(run, f"graph {kind}, node string, place long")


def closure(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``(graph, node)``: the targets and all they rest on, by rounds of joins until nothing is new."""
    links = cut(edges.select("graph", "src", "dst").distinct(), "edges")
    found = cut(targets.select("graph", "node").distinct(), "closure")
    newest = found
    while True:
        step = newest.join(links, (newest["graph"] == links["graph"]) & (newest["node"] == links["dst"])).select(links["graph"], links["src"].alias("node")).distinct()
        newest = cut(step.join(found, ["graph", "node"], "left_anti"), "closure")
        if newest.isEmpty():
            return found
        found = cut(found.unionByName(newest), "closure")


def cycles(order: DataFrame) -> DataFrame:
    """``(graph, n_nodes)`` of graphs whose dependencies hold a cycle: their nodes without a place in :func:`ordered`."""
    return order.where("place is null").groupBy("graph").agg(F.count("*").alias("n_nodes"))


def source_problems(sources: DataFrame, graphs: DataFrame) -> DataFrame:
    """``(graph, document_id, problem)``: external sources that repeat each other or the main document, or that no graph has.

    ``sources``: ``graph, document_id``; ``graphs``: ``graph, document_id`` of the main document.
    """
    every = sources.select("graph", "document_id", F.lit(1).alias("own")).unionByName(graphs.select("graph", "document_id", F.lit(0).alias("own")))
    counts = every.groupBy("graph", "document_id").agg(F.count("*").alias("n"), F.sum("own").alias("own")).where("own > 0")
    rows = counts.join(graphs.select("graph", F.lit(True).alias("known")), "graph", "left")
    problem = F.when(F.col("known").isNull(), "unknown_graph").when(F.col("document_id").isNull(), "no_id").when(F.col("n") > 1, "duplicate")
    return rows.select("graph", "document_id", problem.alias("problem")).where("problem is not null")


def manual_problems(manual: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph, node, problem)`` of nodes anchored by hand: blank or repeated ids, ids that the parser gave, kinds not allowed."""
    known = nodes.select("graph", "node").distinct().withColumn("known", F.lit(True))
    again = manual.groupBy("graph", "node").agg(F.count("*").alias("n"), F.min("kind").alias("kind"), F.sum((~F.coalesce(F.col("kind").isin(*MANUAL_KINDS), F.lit(False))).cast("int")).alias("odd"))
    rows = again.join(known, ["graph", "node"], "left")
    problem = (
        F.when(F.coalesce("node", F.lit("")) == "", "invalid_id").when(F.col("known") | (F.col("n") > 1), "duplicate_id").when(F.col("odd") > 0, "kind")
    )
    return rows.select("graph", "node", problem.alias("problem")).where("problem is not null")


def with_manual(nodes: DataFrame, manual: DataFrame) -> DataFrame:
    """The parsed nodes, and after them those anchored by hand that break no rule (``manual``: ``graph, node, pos, kind``)."""
    bad = manual_problems(manual, nodes).select("graph", "node")
    last = nodes.groupBy("graph").agg((F.max("pos") + 1).alias("base"))
    own = manual.join(bad, ["graph", "node"], "left_anti").join(last, "graph", "left")
    return nodes.select("graph", "node", "pos", "kind").unionByName(own.select("graph", "node", (F.col("pos") + F.coalesce("base", F.lit(0))).cast("long").alias("pos"), "kind"))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _none(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) < 1


def claim_problems(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(graph, claim_id, problem)``: the first rule that a claim breaks.

    ``claims``: ``graph, claim_id, kind, text, nodes array, basis, evidence array``. A claim needs a known kind
    and a text, at least one known node, evidence, and a basis.
    """
    known = nodes.select("graph", F.col("node").alias("named")).distinct().withColumn("known", F.lit(1))
    named = claims.select("graph", "claim_id", F.explode("nodes").alias("named")).join(known, ["graph", "named"], "left")
    lost = named.groupBy("graph", "claim_id").agg(F.sum(F.col("known").isNull().cast("int")).alias("lost"))
    problem = (
        F.when(~F.coalesce(F.col("kind").isin(*CLAIMS), F.lit(False)) | _blank(F.col("text")), "kind_or_text").when(_none(F.col("nodes")) | (F.coalesce("lost", F.lit(0)) > 0), "nodes")
        .when(_none(F.col("evidence")), "evidence").when(~F.coalesce(F.col("basis").isin(*CLAIM_BASES), F.lit(False)), "basis")
    )
    return claims.join(lost, ["graph", "claim_id"], "left").select("graph", "claim_id", problem.alias("problem")).where("problem is not null")


def claim_findings(claims: DataFrame) -> DataFrame:
    """``(graph, claim_id, finding)`` of claims ``(graph, claim_id, kind, basis, evidence array<struct<external boolean>>)``.

    Who or what brought an idea about is unsupported unless a source says so; a historical
    origin needs evidence in the paper and in an outside source; what is unverified stays open.
    """
    own, outside = F.exists("evidence", lambda x: ~x["external"]), F.exists("evidence", lambda x: x["external"])
    found = F.array_compact(F.array(
        F.when(F.col("kind").isin(*ATTRIBUTIONS) & (F.coalesce("basis", F.lit("")) != "explicit_source"), "unsupported_attribution"),
        F.when((F.col("kind") == "historical_origin") & ~F.coalesce(own & outside, F.lit(False)), "primary_source_not_checked"),
        F.when(F.col("basis") == "unverified", "unverified_claim"),
    ))
    return claims.select("graph", "claim_id", F.explode(found).alias("finding"))


_PARTS = ("obstruction", "mechanism", "idea")


def argument_problems(arguments: DataFrame) -> DataFrame:
    """``(graph, node, problem)``: the first rule that the record of an argument breaks.

    ``arguments``: ``graph, node, statement, conclusion, hypotheses array, obstruction, mechanism, idea struct<text, evidence array>, status``;
    statement and conclusion are anchors or null.
    """
    problem = F.when(F.col("statement").isNull() | F.col("conclusion").isNull(), "anchor").when(F.col("hypotheses").isNull(), "hypotheses")
    for part in _PARTS:
        problem = problem.when(_blank(F.col(f"{part}.text")), part).when(_none(F.col(f"{part}.evidence")), f"{part}_evidence")
    problem = problem.when(~F.coalesce(F.col("status").isin("reviewed", "unresolved"), F.lit(False)), "status")
    return arguments.select("graph", "node", problem.alias("problem")).where("problem is not null")


def argument_findings(targets: DataFrame, arguments: DataFrame) -> DataFrame:
    """``(graph, node, finding)``: targets without the record of an argument, or with an unresolved one."""
    own = arguments.select("graph", "node", "status", F.lit(True).alias("there")).dropDuplicates(["graph", "node"])
    rows = targets.select("graph", "node").distinct().join(own, ["graph", "node"], "left")
    finding = F.when(F.col("there").isNull(), "missing_argument_record").when(F.col("status") == "unresolved", "unresolved_argument")
    return rows.select("graph", "node", finding.alias("finding")).where("finding is not null")


def coverage_findings(needed: DataFrame, nodes: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """``(graph, node, finding)`` over needed nodes: proof not reviewed, assumed, with a gap, or a leaf to look at.

    ``coverage``: ``graph, node, status`` ("reviewed", "assumed", "gap"; anything else is no review) and ``note``. A
    reviewed result that rests on nothing and bears no note must be looked at.
    """
    leaves = needed.join(edges.select("graph", F.col("dst").alias("node")).distinct(), ["graph", "node"], "left_anti").select("graph", "node", F.lit(True).alias("leaf"))
    rows = needed.join(nodes.select("graph", "node", "kind"), ["graph", "node"]).join(coverage.select("graph", "node", "status", "note"), ["graph", "node"], "left").join(leaves, ["graph", "node"], "left")
    status = F.col("status")
    finding = (
        F.when(~F.coalesce(status.isin("reviewed", "assumed", "gap"), F.lit(False)), "missing_proof_review").when(status != "reviewed", F.concat(F.lit("proof_"), status))
        .when(~F.col("kind").isin(*GIVEN) & F.col("leaf") & _blank(F.col("note")), "leaf_result_needs_review")
    )
    return rows.select("graph", "node", finding.alias("finding")).where("finding is not null")


def reading_findings(ranges: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(graph, start, end)``: what of each source no reading covers; any row is a finding "incomplete_source_reading".

    ``ranges``: ``graph, start, end``; ``lengths``: ``graph, length``. Ranges may overlap and be repeated.
    """
    before = Window.partitionBy("graph").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.select("graph", "start", "end").unionByName(lengths.select("graph", F.col("length").alias("start"), F.col("length").alias("end")))
    rows = ends.withColumn("cursor", F.coalesce(F.max("end").over(before), F.lit(0)))
    return rows.where("start > cursor").select("graph", F.col("cursor").cast("long").alias("start"), F.col("start").cast("long").alias("end"))


def reconstructions(graphs: DataFrame, order: DataFrame, needed: DataFrame, findings: DataFrame) -> DataFrame:
    """``(graph, prerequisite_order, excluded, findings, evidence_integrity, mathematical_validity, reconstruction_sha256)``.

    The hash is over all the other columns as JSON, so a review of another reconstruction can be told.
    ``findings``: ``graph, finding, about``. Nothing here certifies a proof.
    """
    marked = order.join(needed.select("graph", "node").distinct().withColumn("needed", F.lit(True)), ["graph", "node"], "left")

    def listed(keep: Column, name: str) -> Column:
        """The nodes in order."""
        return F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", "node")))), lambda x: x["node"]).alias(name)

    chains = marked.groupBy("graph").agg(listed(F.col("needed").isNotNull(), "prerequisite_order"), listed(F.col("needed").isNull(), "excluded"))
    open_ = findings.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("finding", "about"))).alias("findings"))
    rows = graphs.select("graph").join(chains, "graph", "left").join(open_, "graph", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("prerequisite_order", "excluded", "findings")})
    rows = rows.withColumns({"evidence_integrity": F.lit("checked"), "mathematical_validity": F.lit("not_certified")})
    return rows.withColumn("reconstruction_sha256", F.sha2(F.to_json(F.struct(F.lit("proof-reconstruction/1").alias("schema"), *rows.columns)), 256))


#: The checks that a review must hold, each once, and how they may end.
REVIEW_CHECKS = ("hypotheses", "dependencies", "mechanisms", "attribution", "scope")
REVIEW_ENDS = ("pass", "fail", "unresolved")


def gate(findings: DataFrame, blockers: DataFrame, checks: DataFrame, graphs: DataFrame) -> DataFrame:
    """``(graph, allowed, n_findings, n_blockers, n_passed)``: allowed if every one of ``REVIEW_CHECKS`` passes and nothing is open.

    ``checks``: ``graph, check, status``; a check that is none of those, or stands twice, lets nothing pass.
    """
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("graph").agg(F.count("*").alias(name))

    known = F.coalesce(F.col("check").isin(*REVIEW_CHECKS), F.lit(False))
    ends = F.coalesce("status", F.lit(""))
    passed = checks.groupBy("graph").agg(F.countDistinct(F.when(known & (ends == "pass"), F.col("check"))).alias("n_passed"), F.count("*").alias("n_checks"))
    rows = graphs.join(count(findings, "n_findings"), "graph", "left").join(count(blockers, "n_blockers"), "graph", "left").join(passed, "graph", "left").na.fill(0)
    wanted = len(REVIEW_CHECKS)
    allowed = (F.col("n_findings") == 0) & (F.col("n_blockers") == 0) & (F.col("n_passed") == wanted) & (F.col("n_checks") == wanted)
    return rows.select("graph", allowed.alias("allowed"), "n_findings", "n_blockers", "n_passed")


def explanation_order(order: DataFrame, needed: DataFrame, known: DataFrame) -> DataFrame:
    """``(graph, node, place)`` of needed nodes that the reader does not know, prerequisites first."""
    return order.join(needed, ["graph", "node"]).join(known.select("graph", "node").distinct(), ["graph", "node"], "left_anti").select("graph", "node", "place")


def receipt_problems(reviews: DataFrame, current: DataFrame) -> DataFrame:
    """``(graph, problem)``: the first rule that a review breaks.

    ``reviews``: ``graph, document_id, candidate_sha256, reconstruction_sha256, checks
    array<struct<id,status,start,end,quote,reason,evidence array>>``; ``current``: ``graph, document_id, candidate,
    reconstruction_sha256``. A review must be of this source, draft and reconstruction, hold each of ``REVIEW_CHECKS``
    once, and each check must have evidence, quote the draft exactly at its place, give a reason and end in a known way. A null never matches.
    """
    now = current.select("graph", F.col("document_id").alias("d"), "candidate", F.sha2("candidate", 256).alias("c"), F.col("reconstruction_sha256").alias("r"), F.lit(True).alias("known"))
    rows = reviews.join(now, "graph", "left")

    def sure(x: Column) -> Column:
        return F.coalesce(x, F.lit(False))

    def quoted(x: Column) -> Column:
        inside = (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.length("candidate"))
        return inside & (F.substr("candidate", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")) == x["quote"])

    def every(rule) -> Column:
        return sure(F.forall("checks", lambda x: sure(rule(x))))

    names = F.array_sort("checks.id")
    problem = (
        F.when(F.col("known").isNull(), "unknown_graph").when(~sure((F.col("candidate_sha256") == F.col("c")) & (F.col("document_id") == F.col("d"))), "stale_candidate")
        .when(~sure(F.col("reconstruction_sha256") == F.col("r")), "stale_reconstruction").when(~sure(names == F.array(*map(F.lit, sorted(REVIEW_CHECKS)))), "checks")
        .when(~every(lambda x: F.size(x["evidence"]) > 0), "evidence").when(~every(lambda x: quoted(x) & ~_blank(x["reason"])), "quote_or_reason")
        .when(~every(lambda x: x["status"].isin(*REVIEW_ENDS)), "status")
    )
    return rows.select("graph", problem.alias("problem")).where("problem is not null")


def accepted(reviews: DataFrame, current: DataFrame) -> DataFrame:
    """``(graph, accepted)`` of every current graph: a review without problems in which all checks pass."""
    bad = receipt_problems(reviews, current).select("graph").distinct()
    passed = reviews.where(F.forall("checks", lambda x: x["status"] == "pass")).join(bad, "graph", "left_anti").select("graph").distinct()
    return current.select("graph").distinct().join(passed.withColumn("ok", F.lit(True)), "graph", "left").select("graph", F.coalesce("ok", F.lit(False)).alias("accepted"))
