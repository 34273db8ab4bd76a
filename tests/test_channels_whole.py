"""Channel queries: tokens are counted within whole documents and not shuffled."""

import math
import re

import pyarrow as pa
import pytest

from lexigauge import registry
from lexigauge.operators import channel_sums, channels
from lexigauge.plans import channels as plan

DOCS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen. 我爱红花 12"), (2, "same " * 150), (3, None), (4, "..."), (5, "我的花得了不其" * 40), (5, "again " * 3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def exchanges(df):
    return len(re.findall(r"^[\s:+-]*(?:\* ?\(\d+\) )?Exchange ", df._jdf.queryExecution().executedPlan().toString(), re.M))


@pytest.mark.parametrize(("name", "rows"), [("channel_vectors", 3), ("sentence_sequences", 3 * (2 + 13 + 24)), ("linguistic_channels", 213), ("predicate_shares", 6), ("channel_states", 6)])
def test_texts_shuffle_once_and_tokens_never(spark, folder, name, rows):
    df = registry.queries()[name](spark, folder)
    assert exchanges(df) <= 5, df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == rows


def test_a_word_that_fills_its_windows(spark, folder):
    got = {r.channel: r.value for r in registry.queries()["window_entropy"](spark, folder).where("doc_id = 2").collect()}
    assert got["lexical.mattr100"] == 0.01 and got["lexical.entropy100"] == 0.0 and 0 < got["upos.bigram_entropy100"] < math.log2(99) / math.log2(289)


def test_documents_stay_whole(monkeypatch):
    monkeypatch.setattr(channel_sums, "CHUNK", 10)
    ids = [d for d, n in ((1, 3), (2, 25), (None, 4), (3, 1), (4, 30)) for _ in range(n)]
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "k": range(len(ids))})
    parts = [x.to_pydict() for x in channel_sums.whole_documents(iter(table.to_batches(max_chunksize=7)))]
    assert sum((p["k"] for p in parts), []) == list(range(len(ids))) and len(parts) > 2
    assert sum(len(set(p["doc_id"])) for p in parts) == 5


@pytest.fixture(scope="module")
def single(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("single"))
    spark.createDataFrame([(i, f"Ein Satz {i} über das Maß. 我们不知道 " * (i % 7)) for i in range(120)] + [(None, "alone")], "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["sentence_sequences", "linguistic_channels", "channel_states", "predicate_shares"])
def test_texts_of_single_ids_do_not_shuffle(spark, single, name):
    df = registry.queries()[name](spark, single)
    assert exchanges(df) == 0, df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [0, 1000])
def test_states_of_the_tokens_are_those_of_their_sentences(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(plan, "_FEW", few)
    ids = [17, 17, 17, 13, 19, 34, 51, 51, None, None, *range(60, 90)]
    spark.createDataFrame([(x, f"{i} Sätze " + f"noun {i} 的 over and over " * (i % 4 * 30)) for i, x in enumerate(ids)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    tokens, sentences = plan._together(spark, str(tmp_path)), plan._sentences(spark, str(tmp_path))
    names = ("upos.NOUN", "dependency.span_mean", "lexical.content_overlap", "lexical.trigram_reuse")
    for measure in (channels.sequences, channels.channels):
        got, want = measure(None, plan._with_state(tokens), names, together=True), measure(sentences, tokens, names)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert {r.missing for r in got.select("missing").distinct().collect()} >= {None, "parse_failed", "pos_only", "zero_denominator"}
