"""The shares hold in every stratum, also where a hot set lies in one source."""

import datetime as dt

import pytest

from lexigauge.llm.grouping import assign_splits

DAY = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize(("hot", "strata"), [(2000, True), (3600, False)])
def test_a_hot_set_inside_one_source(spark, hot, strata):
    rows = [(f"r{i}", "hot" if i < hot else f"c{i}", "web" if i < 4000 else "news", "HUMAN", "TRAIN", {}, DAY, DAY) for i in range(6000)]
    table = spark.createDataFrame(rows, "id string, component_id string, source string, condition string, split string, features map<string,double>, measured_at timestamp, received_at timestamp")
    documents = spark.createDataFrame([], "document_id string, leakage struct<work_id:string,lineage_id:string>")
    targets = spark.createDataFrame([("TRAIN", 0.8 if strata else 0.7), ("DEV", 0.1 if strata else 0.15), ("TEST", 0.1 if strata else 0.15)], "split string, share double")
    got = {r.id: r.split for r in assign_splits(table, documents, targets).collect()}
    assert len(got) == 6000 and len({got[f"r{i}"] for i in range(hot)}) == 1
    part = lambda ids, s: sum(got[f"r{i}"] == s for i in ids) / len(ids)
    for s, share in ((r.split, r.share) for r in targets.collect()):
        assert part(range(6000), s) == pytest.approx(share, abs=0.02)
        if strata:
            assert part(range(4000), s) == pytest.approx(share, abs=0.02) and part(range(4000, 6000), s) == pytest.approx(share, abs=0.02)
