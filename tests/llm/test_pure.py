"""The parts that need no session, against brute force."""

import random
import re
import sys
import unicodedata

import numpy as np
import pytest

from lexigauge.llm import toxicity
from lexigauge.llm.contamination import _Automaton
from lexigauge.llm.leakage import band_keys
from lexigauge.llm.normal import letters_digits, offsets, run_hashes
from lexigauge.llm.quantiles import Sketch
from lexigauge.llm.sentences import Model
from lexigauge.llm.splitting import _RangeMaximum, pieces
from lexigauge.llm.tokens import DEFAULT_VOCABULARY, Encoder

PERCENTS = (1, 5, 25, 50, 75, 95, 99)


def test_letters_and_digits_keep_their_places():
    text = "Ａ１ été — ﬁx_9"
    plain, places = offsets(text)
    assert plain == letters_digits(text) == "a1étéfix9"
    assert [text[i] for i in places][:2] == ["Ａ", "１"] and text[places[-1]] == "9"


def test_run_hashes_are_sets_of_runs():
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice("abc漢字") for _ in range(rng.randint(5, 60)))
        assert len(run_hashes(t, 5)) == len({t[i : i + 5] for i in range(len(t) - 4)})
    assert len(run_hashes("", 5)) == 0 and len(run_hashes("ab", 5)) == 1


@pytest.mark.parametrize("n", [0, 1, 7, 5000, 120_000])
def test_sketch_stays_within_its_bound(n):
    values = np.round(np.random.default_rng(n).normal(size=n), 2)
    whole, parts = Sketch(256), [Sketch(256) for _ in range(5)]
    for i, chunk in enumerate(np.array_split(values, 37)):
        parts[i % 5].add(chunk)
    for p in parts:
        whole.merge(p.count, p.error, p.buffers())
    assert whole.count == n
    ordered = np.sort(values)
    for p, v in zip(PERCENTS, whole.quantile(PERCENTS)):
        if not n:
            assert v is None
            continue
        rank = max(1, -(-p * n // 100))
        low, high = np.searchsorted(ordered, v, "left") + 1, np.searchsorted(ordered, v, "right")
        assert max(low - rank, rank - high, 0) <= whole.error
    assert n > 1000 or whole.error == 0


def test_near_pairs_equal_brute_force():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh") for _ in range(80)) for _ in range(12)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        return "".join(t)

    a, b = [changed(rng.choice(base)) for _ in range(40)], [changed(rng.choice(base)) for _ in range(60)]
    sets = lambda rows: [run_hashes(t, 5) for t in rows]
    x, y = sets(a), sets(b)
    want = {(i, j) for i, g in enumerate(x) for j, h in enumerate(y) if len(np.intersect1d(g, h)) >= 0.6 * len(np.union1d(g, h))}
    keys = [[set(band_keys(g)) for g in side] for side in (x, y)]
    hits = {(i, j) for i, g in enumerate(keys[0]) for j, h in enumerate(keys[1]) if g & h}
    assert want and want <= hits and len(hits) < 0.1 * len(a) * len(b)


def test_range_maximum():
    values = np.random.default_rng(2).integers(0, 9, 100)
    index = _RangeMaximum(values)
    assert all(index.over(i, j) == values[i:j].max() for i in range(100) for j in range(i + 1, 101))


def test_pieces_cover_overlap_and_stay_under_the_limit():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "End. ", "\n\n", "\r\n", "語。", "𝔄", "# h\n"]) for _ in range(rng.randint(0, 200)))
        most = rng.randint(5, 120)
        overlap = rng.randint(0, min(4, most - 1))
        cuts = pieces(text, most, overlap)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= most for a, b in cuts)
        assert all(d[0] == c[1] - overlap for c, d in zip(cuts, cuts[1:]))
        assert (len(cuts) > 1) == (len(text) > most)
    assert pieces("x" * 100, 40, 10) == [(0, 40), (30, 70), (60, 100)]
    assert pieces("a. " * 10 + "\n\n" + "b" * 20, 40, 5)[0] == (0, 32)
    with pytest.raises(ValueError):
        pieces("x" * 10, 4, 4)


def test_encoder_equals_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    own = Encoder(DEFAULT_VOCABULARY)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["", " ", "<|endoftext|>", "a" * 3000, "中" * 900, "don't  stop\n\n x", "x\x1cy z w"]
    texts += ["".join(rng.choice("ab é中文の…'s \n  ١٢ก็🙂﻿") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<i4").tolist() == known.encode_ordinary(t)


def test_items_held_equal_brute_force():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(20)] + [(20, "short"), (21, "!!"), (22, "")]
    own = _Automaton(items, 12)
    runs = {i: {p[k : k + 12] for k in range(len(p) - 11)} or ({p} if p else set()) for i, p in ((i, letters_digits(t)) for i, t in items)}
    for _ in range(60):
        i, t = rng.choice(items[:20])
        doc = "Intro: " + t[: rng.randint(10, len(t))].upper() + " end"
        plain = letters_digits(doc)
        want = {i for i, r in runs.items() if r and sum(x in plain for x in r) * 2 >= len(r)}
        assert {h[0] for h in own.held(doc, 0.5, True)} == want
    hit = own.held("xx " + items[0][1] + " yy", 0.5, True)[0]
    assert ("xx " + items[0][1] + " yy")[hit[3] : hit[4]].strip() == items[0][1]


def _texts():
    starts = ["The ring is flat.", "So it goes on.", "We met Dr. Noel at 9 a.m. in town.", "Is it free?", "It costs 3.50 now.", "He said: \"It is done.\"", "Then the proof ends.", "'All is well.' So they say."]
    rng = random.Random(7)
    out = []
    for _ in range(500):
        own = [rng.choice(starts) for _ in range(8)]
        out.append("".join(s + rng.choice([" ", " ", "\n"]) for s in own).strip())
    return out, starts


def test_sentences_of_dots_quotes_and_breaks():
    texts, starts = _texts()
    model = Model()
    model.train(texts)
    whole = {*starts, "'All is well.'", "So they say."}
    got = [t[a:b] for t in texts for a, b in model.units(t)]
    right = sum(g in whole for g in got) / len(got)
    assert right > 0.97
    assert model.units("") == [] and model.units("— . —\n…") == []
    for t in ("a\r\nb", "﻿One.　\n Two"):
        for a, b in model.units(t):
            assert t[a:b] == t[a:b].strip().strip("﻿")


def test_thai_spaces_are_learned_from_line_breaks():
    rng = random.Random(8)
    units = ["ริงเปิดทุกตัว", "มีกลุ่มอยู่ 79 ตัวที่ปิด", "ค่าเพิ่มจาก 5 เป็น 7 เท่านั้น", "เพราะเหตุใดจึงเปิด"]
    texts = ["".join(rng.choice(units) + rng.choice([" ", " ", "\n"]) for _ in range(6)).strip() for _ in range(600)]
    model = Model()
    model.train(texts)
    got = [t[a:b] for t in texts for a, b in model.units(t)]
    assert sum(g in units for g in got) / len(got) > 0.97


def test_unmarked_runs_are_parted_as_marked_ones_are():
    rng = random.Random(10)
    heads, tails = ["我们先看", "审稿人写道", "下面比较", "请注意"], ["这个问题", "第二份草稿", "平坦的群", "开的集合"]
    unit = lambda: rng.choice(heads) + rng.choice(tails)
    texts = ["".join(unit() + rng.choice(["。", "。", "。\n"]) for _ in range(8)) for _ in range(300)]
    model = Model()
    model.train(texts)
    wanted = found = 0
    for _ in range(50):
        parts = [unit() for _ in range(8)]
        got = [line[a:b] for line in ["".join(parts)] for a, b in model.units(line)]
        wanted, found = wanted + len(parts), found + sum(p in parts for p in got)
    assert found > 0.9 * wanted


def test_each_passage_has_its_own_span():
    item = "every flat chamber meets exactly seven doors and each door opens twice"
    text = "Σίσυφος ＡΣ. " + item[:34].upper() + " -- (something else stands here, long enough) -- " + item[34:] + "."
    (_, found, runs, a, b), (*_, c, d) = _Automaton([(7, item)], 12).held(text, 0.5, True)
    assert found < runs and text[a:b].lower() == item[:34].strip() and text[c:d] == item[34:].strip() and b < c
    assert offsets("ΑΣ Ὀδυσσεύς ß ﬁ İ")[0] == letters_digits("ΑΣ Ὀδυσσεύς ß ﬁ İ")


def test_abuse_is_found_however_spelled():
    rng = random.Random(9)
    plain = ["the ring is flat and open", "every proof needs a lemma", "we compare the two maps", "the study counts insults in forums", "a moron proof lock is sold"]
    bad = ["you are a worthless moron", "shut up you filthy pig", "those people are vermin"]
    doc = lambda extra=(): ". ".join(rng.sample([*(rng.choice(plain) for _ in range(5)), *extra], 5 + len(extra))) + "."
    model = toxicity.fitted([doc([rng.choice(bad)]) for _ in range(300)], [doc() for _ in range(900)])
    assert max(model.score(doc()) for _ in range(100)) < toxicity.THRESHOLD
    for t in (*bad, "You are a w o r t h l e s s MORON", "you are a w0rthle5s mоrоn", "shut up you f​i​l​t​h​y pig", "you are a woooorthless m***n"):
        assert model.score(doc() + " " + t + ".") >= toxicity.THRESHOLD, t
    assert model.score("") == 0.0
    assert toxicity.fitted([], []).score("you are a stupid idiot") == 0.0


def test_normal_forms_are_whole():
    assert re.fullmatch(r"[^\W_]*", letters_digits("".join(map(chr, range(32, 3000)))))
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi" and sys.version_info >= (3, 11)
