"""Intervals, components, English, drafts, papers, proofs, channels, uploads and files on small tables."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexigauge.operators import cards, channels, components, editorial, english, intervals, papers, proofs
from lexigauge.sources import files
from lexigauge.streaming import uploads


def spans(spark, *rows):
    return spark.createDataFrame(rows, "doc_id long, start long, end long")


def test_intervals(spark):
    own, size = spans(spark, (1, 0, 3), (1, 3, 5), (1, 7, 9)), spark.createDataFrame([(1, 10), (2, 0)], "doc_id long, length long")
    assert [(r.start, r.end) for r in intervals.components(own).orderBy("component").collect()] == [(0, 5), (7, 9)]
    gap = intervals.gaps(own, size)
    assert sorted((r.doc_id, r.start, r.end) for r in gap.collect()) == [(1, 5, 7), (1, 9, 10)]
    assert all(r.is_partition for r in intervals.partitions(own, gap, size).collect())
    assert {r.doc_id: r.is_partition for r in intervals.partitions(own, gap.limit(0), size).collect()} == {1: False, 2: True}
    assert intervals.invalid(spans(spark, (1, 0, 4), (1, 3, 5), (1, 9, 11), (1, 5, 5)), size).first().n_bad == 3
    unit = spark.createDataFrame([(1, 1, 0, 4), (1, 2, 4, 8), (1, 3, 9, 10)], "doc_id long, sentence long, start long, end long")
    assert {r.sentence: r.state for r in intervals.selected(unit, own).collect()} == {1: "complete", 2: "clipped"}


def test_gaps_never_make_pairs(spark):
    size = spark.createDataFrame([(1, 40)], "doc_id long, length long")
    s = spark.createDataFrame([(1, i, 0, 10 * i, 10 * i + 10, i + 1) for i in range(4)], "doc_id long, sentence long, paragraph long, start long, end long, chars long")
    p = spark.createDataFrame([(1, 0, 0, 40, 10)], "doc_id long, paragraph long, start long, end long, chars long")
    row = intervals.projected(p, s, spans(spark, (1, 0, 20), (1, 21, 40)), size).first()
    assert row.pairs == 1 and row.clipped_paragraphs == 1 and row.f002 is None and row.f013 is None
    c = intervals.counters(s, spans(spark, (1, 0, 20), (1, 21, 40)), size).first()
    assert c.pairs == c.pairs_same_component + c.pairs_across_components + c.pairs_clipped + c.pairs_with_excluded == 3
    assert c.target_codepoints + c.excluded_codepoints == c.source_codepoints == 40


def test_digest_is_canonical(spark):
    assert intervals.digest({"b": 1, "a": "é"}) == hashlib.sha256('{"a":"é","b":1}'.encode()).hexdigest()
    texts = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert intervals.target_digests(texts, spans(spark, (1, 0, 2), (1, 3, 4))).first().target_sha256 == intervals.digest(["ab", "d"])


def test_components_weigh_alike(spark):
    rows = spark.createDataFrame(
        [("TRAIN", "web", c, k, "F", v) for c, k, v in (("HUMAN", "a", 0.0), ("HUMAN", "a", 2.0), ("HUMAN", "b", 9.0), ("HUMAN", "c", None), ("CHATGPT", "a", 4.0), ("CHATGPT", "b", 5.0))],
        "split string, source string, condition string, component_id string, feature_id string, value double",
    )
    m = components.moments(rows).where("condition = 'HUMAN'").first()
    assert (m["mean"], m.components, m.missing_documents, m.unavailable_components) == (5.0, 2, 1, 1)
    d = components.contrasts(rows).first()
    assert (d.paired_components, d.human_minus_chatgpt) == (2, 0.5)
    again = [tuple(components.bootstrap(rows.repartition(n), 50).first()) for n in (1, 3)]
    assert again[0] == again[1] and again[0][3] <= 0.5 <= again[0][4]
    assert components.bootstrap(rows, 0).count() == 0 and components.moments(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        components.bootstrap(rows, True)


def test_english(spark):
    docs = spark.createDataFrame([(1, "For example, we can see how it goes here.\n\nToo short.\n \nHowever $x^2$ costs $5 and more than we like."), (2, None), (3, "")], "doc_id long, text string")
    p = english.prepared(docs)
    assert {(r.doc_id, r.paragraph): r.kept for r in p.collect()} == {(1, 0): True, (1, 1): False, (1, 2): True, (3, 0): False}
    assert "MATHEXPR" in english.elided(p.where("kept and paragraph = 2")).first().text
    rates = english.cue_rates(p).first()
    assert rates.cue_for_example > 0 and rates.cue_we_can > 0 and rates.cue_note_that == 0
    forms = [f"w{'abcdefg'[i % 7]}" for i in range(130)]
    t = spark.createDataFrame([(1, i, f) for i, f in enumerate(forms)] + [(2, 0, "x")], "doc_id long, pos long, form string")
    want = sum(len(set(forms[i : i + 100])) for i in range(31)) / 3100
    assert {r.doc_id: r.mattr for r in english.mattr(t).collect()} == {1: pytest.approx(want), 2: None}
    bands = spark.range(1).select(*(english.length_band(F.lit(n)).alias(f"b{n}") for n in (500, 501, 2001, 5001))).first()
    assert tuple(bands) == ("<=500", "501-2000", "2001-5000", ">5000")


def test_drafts(spark):
    a = "Keep `code` and $x$ as is. At least 3 rings.\n\n> quoted\n"
    pairs = spark.createDataFrame([(1, a, a), (2, a, a.replace("$x$", "$y$")), (3, a, a.replace("3 rings", "4 rings, not 3")), (4, None, a), (5, a, a + "​")], "pair_id long, original string, candidate string")
    got = {r.pair_id: r for r in editorial.review(pairs).collect()}
    assert got[1].status == "NO_MECHANICAL_FINDINGS" and got[2].status == got[4].status == "BLOCKED_PROTECTED_CHANGE" and got[3].status == "REVIEW_REQUIRED" and got[3].n_logic == 1
    diff = {(r.pair_id, r.item): (r.removed, r.added) for r in editorial.multiset_diff(pairs, r"\d+").collect()}
    assert diff == {(3, "4"): (0, 1), (4, "3"): (0, 1)}
    locks = spark.createDataFrame([("rings",), ("absent",), ("",), (None,)], "literal string")
    assert {(r.pair_id, r.literal): r.state for r in editorial.lock_counts(pairs, locks).collect()}[1, "absent"] == "absent"
    docs = pairs.select(F.col("pair_id").alias("doc_id"), F.col("candidate").alias("text"))
    assert [(r.doc_id, r.codepoint, r.name) for r in editorial.invisible(docs).collect()] == [(5, "U+200B", "ZERO WIDTH SPACE")]
    maths = "$$a$$\n\n$$b$$ x\n\\[c\\]\n$d$\n"
    assert len(editorial.displays(maths)) == 4 and {f[0] for f in editorial.presentation(maths)} == {"display_math_budget_exceeded", "adjacent_display_math"}
    twice = spark.createDataFrame([(1, "p q\n\nr\n\n p q ")], "doc_id long, text string")
    assert editorial.repeated_paragraphs(twice).first().n == 2
    assert editorial.prose(a) != a and len(editorial.prose(a)) == len(a)


TEX = r"""\newtheorem{satz}{Theorem}
\section{One}
\begin{satz}\label{t:a} See \ref{t:b, t:none}. \end{satz} % \begin{lemma}
\begin{lemma}\label{t:b} x \begin{proof} y \end{proof} \end{lemma}
\section{Two} \begin{remark} \cite[p.~2]{k1, k2} \begin{lemma}
\begin{thebibliography}{9}\bibitem{k1} A \bibitem{k2} B\end{thebibliography}"""


def test_papers(spark):
    table = spark.createDataFrame([("p", TEX, None, None, None), ("p", TEX, None, None, None), ("m", "# A\n\n**Theorem 1.** x\n\nLemma: y\n# B\n`# no`", None, "markdown", "s"), ("c", None, ["# C", "\n定理 1"], "text", "s"), ("e", "", None, "text", None)], "paper_id string, text string, chunks array<string>, format string, source string")
    parsed = papers.parsed(papers.content(table))
    nodes = {(r.paper_id, r.id): r for r in papers.exploded(parsed, "nodes").collect()}
    assert [nodes["p", f"n{i}"].kind for i in (1, 2, 3)] == ["theorem", "lemma", "proof"] and nodes["p", "n1"].section == "One"
    assert {k for k in nodes if k[0] == "p"} == {("p", "n1"), ("p", "n2"), ("p", "n3")}
    assert [nodes["m", f"n{i}"].kind for i in (1, 2)] == ["theorem", "lemma"] and nodes["c", "n1"].kind == "theorem"
    refs = {r.label: r.targets for r in papers.reference_candidates(parsed).collect()}
    assert refs == {"t:b": ["n2"], "t:none": []}
    cites = papers.exploded(parsed, "citations").first()
    assert cites["keys"] == ["k1", "k2"] and TEX[cites.start : cites.end].startswith("\\cite")
    assert [r.key for r in papers.exploded(parsed, "bibliography").orderBy("start").collect()] == ["k1", "k2"]
    assert sum("unclosed" in w for w in parsed.where("paper_id = 'p'").first().warnings) == 2
    assert [r.valid for r in papers.changed(parsed, parsed).collect()] == [True] * 3
    win = papers.windows(papers.content(table).where("paper_id = 'p'"), 100).orderBy("start").collect()
    assert "".join(r.window for r in win) == TEX and win[-1].next_start is None
    assert papers.exploded(papers.parsed(papers.content(table.limit(0))), "nodes").count() == 0


def test_proofs(spark):
    n = spark.createDataFrame([("g", x, i, "lemma") for i, x in enumerate("abcde")] + [("h", "a", 0, "remark"), ("h", "b", 1, "lemma")], "graph string, node string, pos long, kind string")
    e = spark.createDataFrame([("g", "a", "c", "application", "r", "explicit_source"), ("g", "b", "c", "guess", "r", "explicit_source"), ("g", "c", "d", "estimate", " ", "explicit_source"), ("h", "a", "b", "estimate", "r", "explicit_source"), ("h", "b", "a", "estimate", "r", "explicit"), ("h", "b", "b", "estimate", "r", "explicit_source"), ("h", "b", "z", "estimate", "r", "explicit_source")], "graph string, src string, dst string, kind string, role string, basis string")
    assert {(r.src, r.dst): r.problem for r in proofs.edge_problems(n, e).collect()} == {("b", "c"): "kind", ("c", "d"): "role", ("b", "a"): "basis", ("b", "b"): "self", ("b", "z"): "unknown_node"}
    place = {(r.graph, r.node): r.place for r in proofs.ordered(n, e).collect()}
    assert [x for _, x in sorted((place["g", x], x) for x in "abcde")] == list("abecd") and place["h", "a"] is None and place["h", "b"] is None
    t = spark.createDataFrame([("g", "d"), ("h", "b")], "graph string, node string")
    assert {(r.graph, r.node) for r in proofs.closure(t, e).collect()} == {("g", x) for x in "abcd"} | {("h", "a"), ("h", "b")}
    assert {r.problem for r in proofs.target_problems(spark.createDataFrame([("h", "a"), ("h", "q"), ("g", "d")], "graph string, node string"), n).collect()} == {"kind", "unknown_node"}
    docs = spark.createDataFrame([(1, "a𝔄b"), (2, None)], "doc_id long, text string")
    anchors = spark.createDataFrame([(1, 1, 1, 3, "𝔄b"), (2, 1, 0, 1, "b"), (3, 1, 2, 9, "b"), (4, 2, 0, 1, "x"), (5, 1, 1, 1, "")], "anchor_id long, doc_id long, start long, end long, quote string")
    assert {r.anchor_id: r.problem for r in proofs.evidence(anchors, docs).collect()} == {1: None, 2: "quote", 3: "offsets", 4: "unknown_document", 5: "offsets"}
    assert proofs.ordered(n.limit(0), e).count() == 0 and proofs.closure(t.limit(0), e).count() == 0


def _tokens(spark):
    rows = [("我", "PRON", 2, "nsubj"), ("爱", "VERB", 0, "root"), ("红", "ADJ", 4, "amod"), ("花", "NOUN", 2, "obj"), ("。", "PUNCT", 2, "punct")]
    return spark.createDataFrame([(1, 0, s, i, *r) for s in (0, 1) for i, r in enumerate(rows, 1)], "doc_id long, comp long, sent long, id long, form string, upos string, head long, deprel string")


def test_channels(spark):
    t = _tokens(spark)
    s = spark.createDataFrame([(1, 0, 0, "ok"), (1, 0, 1, "ok")], "doc_id long, comp long, sent long, status string")
    got = {r.channel: r.value for r in channels.channels(s, t).collect()}
    assert len(got) == 71
    want = {"upos.PRON": 0.25, "deprel.amod": 0.333333333, "cue.pronoun_first": 0.25, "dependency.span_mean": 1.333333333, "dependency.depth_mean": 1.0, "dependency.maxdepth_median": 2.0, "lexical.trigram_reuse": 0.5, "lexical.content_overlap": 1.0, "syntax.initial_pos_reuse": 1.0, "syntax.verb_root_without_subject": 0.0, "syntax.preposed_modifiers": 1.0, "word.single_han": 1.0}
    assert {k: got[k] for k in want} == want and got["lexical.mattr100"] is None
    bad = {r.channel: r.missing for r in channels.channels(s.withColumn("status", F.lit("pos_only")), t).collect()}
    assert bad["deprel.amod"] == "pos_only" and bad["upos.PRON"] is None
    assert channels.parse_problems(s, t).count() == 0
    assert {r.problem for r in channels.parse_problems(s, t.where("not (sent = 0 and id = 2) and sent = 0")).collect()} == {"ids", "missing_parse"}
    assert channels.edges(t).groupBy("kind").count().where("kind = 'original_next_sentence'").first()["count"] == 1
    assert len(channels.vectors(channels.channels(s, t)).first().value) == 71


def test_parse_coverage(spark):
    rows = [("a", 0, "ok", "complete"), ("a", 0, "ok", "complete"), ("a", 2, "failed", "clipped"), ("b", 0, "pos_only", "complete"), (None, 0, "ok", "complete"), ("c", None, "ok", "complete")]
    got = {r.document_id: r for r in channels.parse_coverage(spark.createDataFrame(rows, "document_id string, source_sentence_index int, status string, analysis_status string")).collect()}
    assert set(got) == {"a", "b"} and (got["a"].n_parses, got["a"].n_repeated, got["a"].n_missing, got["a"].complete) == (3, 1, 1, False) and got["b"].complete


def test_review_counts_all_that_lint_does(spark):
    rows = [(1, "a", "a\u202eb"), (2, "a", "x y\n\nx y"), (3, "keep it", "kept"), (4, "a $x$", "a $y$"), (5, "a", "a"), (6, None, None), (7, "at most 3 `4`", "at most 5 `4`"), (8, "no lock", "no lock")]
    pairs = spark.createDataFrame(rows, "pair_id long, original string, candidate string")
    got = {r.pair_id: r for r in editorial.review(pairs).collect()}
    assert {k: r.status.split("_")[0] for k, r in got.items()} == {1: "REVIEW", 2: "REVIEW", 3: "NO", 4: "BLOCKED", 5: "NO", 6: "NO", 7: "REVIEW", 8: "NO"}
    assert (got[1].n_invisible, got[2].n_repeated, got[7].n_quantity) == (1, 1, 2)
    locked = {r.pair_id: r.status for r in editorial.review(pairs.where("pair_id in (3, 8)"), ("keep",)).collect()}
    assert locked == {3: "BLOCKED_PROTECTED_CHANGE", 8: "LOCK_ABSENT"} and editorial.review(pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        editorial.review(pairs, ("",))
    assert {(r.item, r.removed, r.added) for r in editorial.prose_diff(pairs.where("pair_id = 7"), "quantity").collect()} == {("3", 1, 0), ("5", 0, 1)}


def test_receipts(spark):
    def checks(names=proofs.REVIEW_CHECKS, status="pass", quote="aft", reason="why", evidence=("a",)):
        return [(n, status, 3, 6, quote, reason, list(evidence)) for n in names]

    c, five = "the draft"[1:], proofs.REVIEW_CHECKS
    quote = {"quote": c[3:6]}
    sha = hashlib.sha256(c.encode()).hexdigest()
    rows = {
        "g": ("d", sha, "y", checks(**quote)), "h": ("d", "old", "y", checks(**quote)), "i": ("d", sha, "old", checks(**quote)), "j": ("d", sha, "y", checks(five[:4], **quote)),
        "k": ("d", sha, "y", checks(status="uncertain", **quote)), "z": ("d", sha, "y", checks(**quote)), "n": ("d", None, "y", checks(**quote)), "o": ("other", sha, "y", checks(**quote)),
        "p": ("d", sha, "y", checks((*five[:4], "five"), **quote)), "q": ("d", sha, "y", checks(quote="drift")), "r": ("d", sha, "y", checks(reason=" ", **quote)), "s": ("d", sha, "y", checks(evidence=(), **quote)),
        "t": ("d", sha, "y", checks(status="fail", **quote)), "u": ("d", sha, "y", None),
    }
    reviews = spark.createDataFrame([(g, *r) for g, r in rows.items()], "graph string, document_id string, candidate_sha256 string, reconstruction_sha256 string, checks array<struct<id:string,status:string,start:int,end:int,quote:string,reason:string,evidence:array<string>>>")
    now = spark.createDataFrame([(g, "d", c, "y") for g in "ghijknopqrstuv"], "graph string, document_id string, candidate string, reconstruction_sha256 string")
    assert {r.graph: r.problem for r in proofs.receipt_problems(reviews, now).collect()} == {
        "h": "stale_candidate", "i": "stale_reconstruction", "j": "checks", "k": "status", "z": "unknown_graph", "n": "stale_candidate", "o": "stale_candidate", "p": "checks", "q": "quote_or_reason",
        "r": "quote_or_reason", "s": "evidence", "u": "checks",
    }
    assert {r.graph for r in proofs.accepted(reviews, now).collect() if r.accepted} == {"g"} and proofs.accepted(reviews, now.limit(0)).count() == 0


def test_findings(spark):
    claims = spark.createDataFrame(
        [("g", 1, "author_motivation", "explicit_source", [(False,)]), ("g", 2, "innovation", "reconstruction", [(False,)]), ("g", 3, "historical_origin", "explicit_source", [(False,)]),
         ("g", 4, "historical_origin", "explicit_source", [(False,), (True,)]), ("g", 5, "limitation", "unverified", None), ("g", 6, "mathematical_motivation", "reconstruction", [(False,)])],
        "graph string, claim_id int, kind string, basis string, evidence array<struct<external:boolean>>",
    )
    assert {(r.claim_id, r.finding) for r in proofs.claim_findings(claims).collect()} == {(2, "unsupported_attribution"), (3, "primary_source_not_checked"), (5, "unverified_claim")}
    n = spark.createDataFrame([("g", x, i, k) for i, (x, k) in enumerate(zip("abcdefg", ["lemma", "lemma", "definition", "lemma", "lemma", "lemma", "lemma"]))], "graph string, node string, pos long, kind string")
    e = spark.createDataFrame([("g", "a", "d")], "graph string, src string, dst string")
    cover = spark.createDataFrame([("g", "a", "reviewed", None), ("g", "b", "reviewed", "seen"), ("g", "c", "reviewed", None), ("g", "d", "reviewed", None), ("g", "e", "assumed", None), ("g", "f", "gap", "n"), ("g", "g", "checked", None)], "graph string, node string, status string, note string")
    assert {(r.node, r.finding) for r in proofs.coverage_findings(n.select("graph", "node"), n, e, cover).collect()} == {("a", "leaf_result_needs_review"), ("e", "proof_assumed"), ("f", "proof_gap"), ("g", "missing_proof_review")}
    made = proofs.reconstructions(n.select("graph").distinct(), proofs.ordered(n, e), n.select("graph", "node").where("node in ('a', 'd')"), spark.createDataFrame([("g", "x", "a")], "graph string, finding string, about string")).first()
    assert made.prerequisite_order == ["a", "d"] and made.excluded == ["b", "c", "e", "f", "g"] and len(made.reconstruction_sha256) == 64
    ranges = spark.createDataFrame([("g", 2, 4), ("g", 2, 3), ("g", 3, 6)], "graph string, start long, end long")
    assert [(r.start, r.end) for r in proofs.reading_findings(ranges, spark.createDataFrame([("g", 9)], "graph string, length long")).orderBy("start").collect()] == [(0, 2), (6, 9)]


CHUNKS = "upload_id string, idx int, total int, text string, format string, source string"


def test_uploads_in_batch(spark):
    rows = [("a", 0, 2, "x", "t", "s"), ("a", 1, 2, "y", "t", "s"), ("a", 1, 2, "y", "t", "s"), ("b", 0, 2, "x", "t", "s"), ("b", 0, 2, "z", "t", "s"), ("c", 0, 1, "x", "t", None), ("c", 0, 1, "x", "u", None), ("d", 5, 2, "x", "t", "s"), ("e", 0, 2, "x", "t", "s"), ("f", 0, 1, "xyz" * 9, "t", "s")]
    got = {r.upload_id: (r.state, r.text) for r in uploads.assembled(spark.createDataFrame(rows, CHUNKS), most=20).collect()}
    assert got == {"a": ("complete", "xy"), "b": ("conflict", None), "c": ("metadata", None), "d": ("index", None), "e": ("incomplete", None), "f": ("too_large", None)}


def test_uploads_as_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    steps = ([("a", 2, 3, "z", "t", "s"), ("b", 0, 1, "q", "t", "s")], [("a", 0, 3, "x", "t", "s"), ("a", 2, 3, "z", "t", "s")], [("a", 1, 3, "y", "t", "s"), ("c", 0, 2, "n", "t", "s")], [("c", 0, 2, "m", "t", "s")])
    rows = []
    for k, step in enumerate(steps):
        spark.createDataFrame(step, CHUNKS).coalesce(1).write.mode("append").json(source)
        run = (
            uploads.stream(spark.readStream.schema(CHUNKS).json(source)).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
            .foreachBatch(lambda df, _, k=k: rows.extend((k, r.upload_id, r.state, r.text) for r in df.collect())).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    assert sorted(rows) == [(0, "b", "complete", "q"), (2, "a", "complete", "xyz"), (3, "c", "conflict", None)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tex").write_bytes("﻿é\r\n".encode())
    (tmp_path / "in" / "b.md").write_bytes(b"# x")
    raw = files.formats(files.raw_texts(spark, str(tmp_path / "in")))
    got = {r.path.rsplit("/", 1)[1]: r for r in raw.collect()}
    assert got["a.tex"].text == "﻿é\r\n" and got["a.tex"].format == "latex" and got["b.md"].sha256 == hashlib.sha256(b"# x").hexdigest()
    listed = spark.createDataFrame([("b.md", got["b.md"].sha256), ("a.tex", "0"), ("z", "1")], "name string, sha256 string")
    assert {r.name: r.state for r in files.verified(raw, listed).collect()} == {"b.md": "ok", "a.tex": "changed", "z": "missing"}
    pages = files.pages(spark, str(tmp_path / "in" / "b.md"), lambda b: ["one", "", "two"]).orderBy("page").collect()
    assert [(r.start, r.end, r.empty) for r in pages] == [(0, 3, False), (5, 5, True), (7, 10, False)]
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert files.json_texts(spark.createDataFrame([("p", '﻿{"a": 1}')], "path string, text string"), schema).first().value.a == 1
    out = str(tmp_path / "out")
    files.write_json(spark.createDataFrame([(1.5,)], "x double"), out)
    assert files.json_lines(spark, out, T.StructType([T.StructField("x", T.DoubleType())])).first().x == 1.5
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_json(spark.createDataFrame([(1.5,)], "x double"), out)
    with pytest.raises(ValueError):
        files.write_json(spark.createDataFrame([(float("nan"),)], "x double"), out + "2")
    files.write_receipt({"a": "é"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"a": "é"}
    with pytest.raises(FileExistsError):
        files.write_receipt({}, str(tmp_path / "r.json"))
    assert files.write_cards({"c.md": "x"}, str(tmp_path / "cards")) == files.write_cards({"c.md": "x"}, str(tmp_path / "cards"))


def test_cards(spark):
    make = lambda *rows: spark.createDataFrame(rows, "feature_id string, difference double, supported boolean")
    a, b = make(("F1", 1.0, True), ("F2", 2.0, False), ("F3", 1.0, True)), make(("F1", -1.0, True), ("F2", 2.0, True))
    assert [tuple(r) for r in cards.unmatched(a, b).collect()] == [("F3", "train")]
    rows = cards.general(a, b)
    assert [(r.feature_id, r.same_sign) for r in rows.collect()] == [("F1", False)] and "| F1 | 1.000 | -1.000 |" in cards.table_text(rows, "t")
