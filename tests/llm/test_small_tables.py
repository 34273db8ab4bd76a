"""Every operator on small tables with nulls, repeats, ties, empty tables and clashing names."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexigauge.llm import queries as q
from lexigauge.llm.contamination import held_items
from lexigauge.llm.grouping import assign_splits, broken_ties, linked_sets
from lexigauge.llm.leakage import leaks
from lexigauge.llm.quantiles import combine, once, percentiles, sketches
from lexigauge.llm.sentences import sentence_units
from lexigauge.llm.splitting import split_items
from lexigauge.llm.tokens import encode_column
from lexigauge.llm.toxicity import scores

DOCS = "doc_id long, text string, source string, n long, ids string, score double, count long"
OBS = "id string, component_id string, source string, condition string, split string, features map<string,double>, measured_at timestamp, received_at timestamp, root string, s string, g string"
MEASURED = "document_id string, text string, leakage struct<work_id:string,lineage_id:string,content_group_id:string,near_duplicate_group_id:string>, class string, train string, key string"
DAY = dt.datetime(2025, 1, 1)


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "s", 1, "x", 0.0, 2) for i, t in enumerate(texts)], DOCS)


def obs(spark, *rows):
    return spark.createDataFrame([(i, c, "web", "HUMAN", s, f, DAY, DAY + dt.timedelta(days=k), "r", "s", "g") for k, (i, c, s, f) in enumerate(rows)], OBS)


def measured(spark, *rows):
    return spark.createDataFrame([(i, t, Row(work_id=w, lineage_id=n, content_group_id=c, near_duplicate_group_id=d), "c", "t", "k") for i, t, w, n, c, d in rows], MEASURED)


def test_encode_column(spark):
    long = "word " * 60_000
    got = {r.doc_id: r.ids for r in encode_column(docs(spark, None, "", " ", "hello", long, "hello")).collect()}
    assert got[0] is None and got[1] == [] and len(got[2]) == 1 and got[3] == got[5] and len(got[4]) > 50_000
    assert encode_column(docs(spark)).count() == 0


def test_held_items(spark):
    item = "fix the integers and call a chamber admissible when it meets seven doors"
    documents = docs(spark, None, "", item.upper() + "!", "nothing at all here", "so: " + item[:50])
    items = spark.createDataFrame([(1, item, "a"), (1, item, "a"), (2, None, "a"), (3, "", "a"), (None, item, "a")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in held_items(documents, items, where=True).collect()}
    assert got == {(2, 1), (4, 1)}
    assert held_items(documents, items.limit(0)).count() == 0 and held_items(docs(spark), items).count() == 0


def test_split_items(spark):
    papers = spark.createDataFrame(
        [("a", "x" * 30, None, "TEXT ", 1), ("a", "x" * 30, None, "TEXT ", 1), ("b", None, ["y" * 15, "z" * 15], None, 1), ("c", None, None, "text", 1), ("d", "", None, "odd", 1), (None, "q", None, "text", 1)],
        "paper_id string, text string, chunks array<string>, format string, piece long",
    )
    limits = spark.createDataFrame([("text", 10, 2), ("latex", 100, 5), (None, 1, 0)], "format string, max_code_points long, overlap_code_points long")
    rows = split_items(papers, limits).collect()
    own = sorted((r.piece, r.text) for r in rows if r.paper_id == "a")
    assert len(own) == 4 and own[0][1] + "".join(t[2:] for _, t in own[1:]) == "x" * 30
    assert {r.paper_id: r.pieces for r in rows} == {"a": 4, "b": 1, "c": 1, "d": 1, None: 1}
    assert split_items(papers.limit(0), limits).count() == 0


def test_quantiles_combine_days(spark):
    rows = [(f"i{k}", "c", "TRAIN", {"F": float(k % 50), "G": None if k % 3 else float("nan")}) for k in range(400)]
    table = obs(spark, *rows, ("i1", "c", "TRAIN", {"F": 999.0}), (None, "c", "TRAIN", {"F": 1.0}), ("j", "c", "TRAIN", None), ("k", "c", "TRAIN", {}))
    own = once(table)
    by = ["source", "condition"]
    direct = percentiles(combine(sketches(own, by, k=16), by, k=16, fan_in=3), by).collect()
    days = combine(sketches(own, [*by, "day"], k=16), [*by, "day"], k=16)
    united = percentiles(combine(days, by, k=16), by).collect()
    for r in (*direct, *united):
        assert (r.feature_id, r.n) == ("F", 401)
        values = sorted([float(k % 50) for k in range(400)] + [1.0])
        rank = -(-50 * 401 // 100)
        assert min(abs(i + 1 - rank) for i, v in enumerate(values) if v == r.p50) <= r.rank_error
    assert percentiles(combine(sketches(own.limit(0), by), by), by).count() == 0


def test_linked_sets_long_chain(spark):
    chain = [(f"m{i:03d}", f"e{i}") for i in range(60)] + [(f"m{i + 1:03d}", f"e{i}") for i in range(59)] + [("z", "zz"), ("z", "zz"), (None, "e1"), ("n", None)]
    got = {r.member: r.root for r in linked_sets(spark.createDataFrame(chain, "member string, entity string")).collect()}
    assert {v for k, v in got.items() if k != "z"} == {"m000"} and got["z"] == "z" and len(got) == 61
    assert linked_sets(spark.createDataFrame([], "member string, entity string")).count() == 0


def _ties(spark):
    o = obs(
        spark, ("a", "c1", "TRAIN", {}), ("b", "c1", " train", {}), ("c", "c2", "DEV", {}), ("d", "c3", None, {}), ("e", "c4", "TEST", {}), ("f", "unknown", "DEV", {}), ("g", "unknown", "TRAIN", {}),
        ("h", None, "DEV", {}), (None, "c1", "TEST", {}), ("a", "c1", "TRAIN", {}),
    )
    m = measured(
        spark, ("a", "t", "W1", None, None, None), ("c", "t", " w1\t", "L1", None, None), ("d", "t", "n/a", "l1", None, None), ("e", "t", "n/a", "tbd", None, None), ("x", "t", "w1", None, None, None), (None, "t", "w9", None, None, None),
    )
    return o, m


def test_broken_ties(spark):
    o, m = _ties(spark)
    # The row without id still belongs to its component, which is in TRAIN and TEST anyway.
    assert sorted(r.id for r in broken_ties(o, m).collect()) == ["a", "b", "c", "d"]
    assert broken_ties(o.limit(0), m).count() == 0 and broken_ties(o, m.limit(0)).count() == 2


def test_assign_splits_keeps_sets_whole(spark):
    rows = [(f"r{i}", "big" if i < 300 else f"c{i % 200}", "TRAIN", {}) for i in range(1000)]
    targets = spark.createDataFrame([("TRAIN", 0.8), ("DEV", 0.1), ("TEST", 0.1), (None, 0.5)], "split string, share double")
    got = assign_splits(obs(spark, *rows), measured(spark), targets).collect()
    assert len(got) == 1000 and len({r.id for r in got}) == 1000
    assert all(len({r.split for r in g}) == 1 for _, g in itertools.groupby(sorted(got, key=lambda r: r.root), key=lambda r: r.root))
    shares = {s: sum(r.split == s for r in got) / 1000 for s in ("TRAIN", "DEV", "TEST")}
    assert abs(shares["TRAIN"] - 0.8) < 0.05 and shares["DEV"] > 0.05
    assert assign_splits(obs(spark), measured(spark), targets).count() == 0
    with pytest.raises(ValueError):
        assign_splits(obs(spark), measured(spark), targets.limit(0))


def test_leaks(spark):
    text = "The quick brown fox jumps over the lazy dog and runs home to sleep all day long."
    near = text.replace("lazy", "hazy")
    m = measured(
        spark, ("t1", text, None, None, "G1", "n/a"), ("t1", text, None, None, "G1", "n/a"), ("t2", "other words entirely, nothing shared", None, None, None, "N1"), ("e1", near, None, None, "-", None), ("e2", "unlike", None, None, " g1", "n1 "),
        ("e3", "12345 67890 12345", None, None, None, None), ("t3", "12345 67890 12345", None, None, None, None), ("e4", text.upper(), None, None, None, None), ("e5", None, None, None, "unknown", None), ("t4", None, None, None, "unknown", None), ("n1", text, None, None, None, None), (None, text, None, None, None, None),
    )
    o = obs(spark, *((i, "c", "Train " if i[0] == "t" else "dev", {}) for i in ("t1", "t2", "t3", "t4", "e1", "e2", "e3", "e4", "e5")), ("n1", "c", None, {}))
    got = {(r.id_a, r.id_b): r.kinds for r in leaks(m, o).collect()}
    assert set(got) == {("e1", "t1"), ("e2", "t1"), ("e2", "t2"), ("e4", "t1")}
    assert got["e1", "t1"] == ["near_text"] and got["e4", "t1"] == ["text"]
    assert leaks(m.limit(0), o).count() == 0 and leaks(m, o.limit(0)).count() == 0


def test_sentence_units(spark):
    m = measured(spark, ("a", "One is here.\nTwo is there. ", None, None, None, None), ("a", "One is here.\nTwo is there. ", None, None, None, None), ("b", None, None, None, None, None), ("c", "", None, None, None, None), ("d", "…\n—", None, None, None, None))
    got = sorted((r.document_id, r.start_cp, r.end_cp, r.content_chars) for r in sentence_units(m).collect())
    assert got == [("a", 0, 12, 9), ("a", 13, 26, 10)]
    assert sentence_units(m.limit(0)).count() == 0


def test_abuse_scores(spark):
    labels = spark.createDataFrame([(0, "r", 1, 5), (0, "r", 1, 5), (1, "r", 0, 1), (2, "r", None, 2), (None, "r", 1, 2)], "doc_id long, rater_id string, toxic int, text int")
    more = spark.createDataFrame([(k, "r", k % 2, 3) for k in range(4, 24)], labels.schema)
    labels = labels.unionByName(more)
    documents = docs(spark, "You are a stupid idiot. The ring is flat.", "The ring is flat.", None, "", *(["The ring is flat.", "The ring is flat. You are a stupid idiot."] * 10))
    got = {r.doc_id: r for r in scores(documents, labels).collect()}
    assert got[2].score is None and not got[2].abusive and got[3].score == 0 and got[0].score > got[1].score
    assert scores(docs(spark), labels).count() == 0 and scores(documents, labels.limit(0)).where(F.col("score").isNull()).count() == 1


def test_every_query_has_columns(spark):
    names = set(q.queries())
    assert {f"p{i}_found" for i in (1, 3, 4, 5, 7, 8)} <= names and "p6_ids" in names and set(q.oracle_sql()) <= names
