"""p1: texts that only share their common n-grams do not become hits, whose number would grow as the square of the table."""

import random

from pyspark.sql import functions as F

from lexigauge.llm import leakage


def test_meetings_by_chance_are_no_hits(spark, monkeypatch):
    rng, kept = random.Random(5), {}
    make = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    common = make(45)
    texts = [common + make(105) for _ in range(160)]
    texts += [t[:-4] for t in texts[:10]]
    rows = [(f"k{i}", t, i < 80, i >= 80) for i, t in enumerate(texts)]
    whole = leakage.cut

    def counted(df, what="step"):
        out = whole(df, what)
        kept[what] = out.count()
        return out

    monkeypatch.setattr(leakage, "cut", counted)
    found = leakage.near_pairs(spark.createDataFrame(rows, "class string, plain string, train boolean, evaluation boolean"))
    assert {(r.class_e, r.class_t) for r in found.select("class_e", "class_t").collect()} == {(f"k{160 + i}", f"k{i}") for i in range(10)}
    # The 7200 pairs share a fifth of their n-grams and often meet in a key.
    assert kept["hits"] <= 40, kept
    assert found.where(F.col("both") <= 0).count() == 0
