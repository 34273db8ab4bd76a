"""The gate counts the open findings of every graph, as coverage_findings lists them."""

from collections import Counter

from lexigauge.plans.proofs import QUERIES

SIZES = {"book-1": 5, "book-2": 12, "book-3": 5, "book-7": 5, "book-000": 4, "book-001": 30}


def test_gate_equals_coverage_findings(spark, tmp_path):
    rows = [(i * 100 + k, name) for i, (name, n) in enumerate(SIZES.items()) for k in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name][0](spark, str(tmp_path)).collect()
    want = Counter(r.graph for r in run("coverage_findings"))
    got = {r.graph: r for r in run("audit_gate")}
    assert set(got) == set(SIZES) and want["book-2"] and want["book-001"] and not want["book-000"]
    assert {g: r.n_findings for g, r in got.items()} == {g: want[g] for g in SIZES}
    # Five nodes hold no target, so nothing is open; the third blocks, the seventh fails a check, four nodes have four checks.
    assert {g for g, r in got.items() if r.allowed} == {"book-1"}
