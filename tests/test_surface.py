"""The surface instrument against a scanner written from the rules, and known arithmetic."""

import random

import pytest

from lexigauge.operators import surface as s


def scan(text):
    """(start, end, content) of sentences, one character at a time."""
    content = lambda t: sum(c.isalpha() or c.isnumeric() for c in t)
    out, pos = [], 0
    for line in text.replace("\r", "\n").split("\n"):
        start, i = 0, 0
        cuts = []
        while i < len(line):
            c = line[i]
            stop = c in s.TERMINALS
            if c == ".":
                k = i
                while k and line[k - 1].isascii() and line[k - 1].isalpha():
                    k -= 1
                after = line[i + 1 : i + 2]
                stop = i - k != 1 and (not after or after.isspace() or after in s.CLOSERS)
            i += 1
            if stop:
                while i < len(line) and line[i] in s.TERMINALS + s.CLOSERS + ".":
                    i += 1
                cuts.append((start, i))
                start = i
        cuts.append((start, len(line)))
        for a, b in cuts:
            while a < b and line[a].isspace():
                a += 1
            while b > a and line[b - 1].isspace():
                b -= 1
            if content(line[a:b]):
                out.append((pos + a, pos + b, content(line[a:b])))
        pos += len(line) + 1
    return out


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_sentences_equal_the_scanner(spark):
    rng = random.Random(1)
    parts = ["A", "ab", "Dr", "J", "3.5", ".", "。", "！", "?", "”", '"', "'", ")", " ", "　", "\n", "\r\n", "漢", "𝔄", "…", "．", "x.y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    got = {}
    for r in s.sentences(frame(spark, *texts)).orderBy("doc_id", "sentence").collect():
        got.setdefault(r.doc_id, []).append((r.start_cp, r.end_cp, r.content_chars))
    for i, t in enumerate(texts):
        assert got.get(i, []) == scan(t), t


def test_known_arithmetic(spark):
    row = s.measured(frame(spark, "一。二二。三三三。四四四四。")).first()
    want = {"f002": 100.0, "f003": 0.0, "f013": 2.5, "f014": 1.5, "f015": 3.7, "f016": 0.4, "f024": 0.4, "f025": 1.0}
    assert all(row[k] == pytest.approx(v) for k, v in want.items())


def test_missing_is_not_zero(spark):
    rows = {(r.doc_id, r.feature_id): r for r in s.features_long(frame(spark, "", "？！", None, "同。同。同。同。同。", "one")).collect()}
    assert {i for i, _ in rows} == {0, 1, 3, 4}
    assert rows[0, "F002"].status == "unavailable" and rows[0, "F013"].value is None
    assert rows[3, "F025"].value is None and rows[3, "F016"].status == "zero_observed" and rows[3, "F024"].value == 0
    assert rows[4, "F024"].value is None and not any(r.eligible for r in rows.values())


def test_paragraphs_and_breaks(spark):
    got = [(r.start_cp, r.end_cp) for r in s.paragraphs(frame(spark, " a b \r\n\r\n— \n﻿二")).orderBy("paragraph").collect()]
    assert got == [(1, 4), (12, 14)]
    assert s.paragraphs(frame(spark)).count() == 0 and s.sentences(frame(spark)).count() == 0


def test_bands_flag_only_the_eligible(spark):
    long = spark.createDataFrame([(1, "F013", 5.0, "observed", True), (1, "F014", 9.0, "observed", False), (1, "F015", None, "unavailable", False)], "doc_id long, feature_id string, value double, status string, eligible boolean")
    bands = spark.createDataFrame([("F013", "web", 6.0, 7.0, True), ("F014", "web", 1.0, 2.0, True), ("F015", "web", None, None, False)], "feature_id string, source string, q10 double, q90 double, supported boolean")
    assert {r.feature_id: r.outside for r in s.band_comparison(long, bands, "web").collect()} == {"F013": True, "F014": None}
