"""The registry works with and without the optional subpackage."""

import importlib
import sys


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 70
    assert set(entry.queries()["content_chars"](spark, "/root/testdata/sf0.001").columns) == {"doc_id", "content_chars"}


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "lexigauge.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert not any(name.startswith("p1_") for name in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
