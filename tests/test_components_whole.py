"""The registered component statistics count every finite value, however large."""

import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest

from lexigauge.registry import queries

DAY = dt.datetime(2025, 1, 1)
ROWS = [
    ("a", "c1", "HUMAN", 2.0), ("b", "c1", "HUMAN", 5e4), ("c", "c2", "HUMAN", -3e12), ("d", "c2", "HUMAN", 1.0), ("e", "c3", "HUMAN", 4.0), ("f", "c3", "HUMAN", None), ("g", "c3", "HUMAN", float("inf")),
    ("h", "c1", "CHATGPT", 1.0), ("i", "c2", "CHATGPT", 7.0), ("j", "c3", "CHATGPT", 1e4),
]


def _mean(values):
    return float(sum(map(Fraction, values)) / len(values))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("obs"))
    dev = [("k", "c4", "HUMAN", 3.0), ("l", "c4", "CHATGPT", 2e5), ("m", "c5", "HUMAN", 1.0), ("n", "c5", "CHATGPT", 1.0)]
    rows = [(i, c, "web", k, s, {"F": v}, DAY, DAY) for s, own in (("TRAIN", ROWS), ("DEV", dev)) for i, c, k, v in own]
    spark.createDataFrame(rows, "id string, component_id string, source string, condition string, split string, features map<string,double>, measured_at timestamp, received_at timestamp").write.parquet(f"{out}/style_observations.parquet")
    return out


def test_extreme_values_count(spark, folder):
    finite = {}
    for _, c, k, v in ROWS:
        finite.setdefault((k, c), []).extend([v] if v is not None and abs(v) < float("inf") else [])
    want = {key: _mean(v) for key, v in finite.items()}
    run = lambda name: [r for r in queries()[name](spark, folder).collect() if r.asDict().get("split", "TRAIN") == "TRAIN"]
    got = run("component_means")
    assert {(r.condition, r.component_id): r["mean"] for r in got} == pytest.approx(want)
    assert {(r.condition, r.component_id): (r.n, r.missing) for r in got if r.missing} == {("HUMAN", "c3"): (1, 2)}
    assert {r.condition: (r.missing_documents, r.unavailable_components) for r in run("missing_accounting")} == {"HUMAN": (2, 0), "CHATGPT": (0, 0)}
    human = [want["HUMAN", c] for c in ("c1", "c2", "c3")]
    moments = {r.condition: r for r in run("component_moments")}["HUMAN"]
    assert moments.components == 3 and (moments["mean"], moments["median"]) == pytest.approx((_mean(human), sorted(human)[1]))
    d = [want["HUMAN", c] - want["CHATGPT", c] for c in ("c1", "c2", "c3")]
    pair = run("paired_contrast")[0]
    assert pair.paired_components == 3 and pair.human_minus_chatgpt == pytest.approx(_mean(d))
    rng = random.Random("0/TRAIN/web/F")
    boot = [_mean(rng.choices(d, k=3)) for _ in range(400)]
    ci = run("bootstrap_ci")[0]
    assert (ci.low, ci.high) == pytest.approx((np.quantile(boot, 0.025), np.quantile(boot, 0.975)))
    card = run("contrast_card")[0]
    assert (card.train, card.dev, card.same_sign) == (pytest.approx(_mean(d)), (3.0 - 2e5) / 2, True)
