"""Problem 8: abusive, hateful or sexually explicit language.

Two Kneser-Ney models, of abusive and of ordinary passages, are trained from a
bounded sample of the labelled documents. Which passages of a document labelled
abusive are so is not known: those whose pairs of tokens other such documents
favour start, then for some rounds models fitted without a document choose its
passages. The same held-out scores give the difference from which a document counts.
A document's score is the greatest length-normalised difference of the two
log-likelihoods over its passages, however spelled.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents of each kind that train the models, and code points of each kind's texts at most.
TRAINING_DOCUMENTS, TRAINING_CODE_POINTS = 6000, 20_000_000
#: Parts of the labelled documents that are held out in turn, rounds in which passages are chosen, tokens of a window.
FOLDS, ROUNDS, WINDOW = 3, 2, 6
#: The share of ordinary documents whose best passage may look as abusive as a passage that is chosen.
CHANCE = 0.02
#: The score from which a document counts: scores are in units of the difference that held-out labels part best.
THRESHOLD = 1.0
#: Tokens that are scored at a time.
BATCH = 200_000

#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕһԁԛԝӏкмтвнΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινκρτυχ", "aeopcyxijshdqwlkmtbnabezhikmnoptyxaoivkptux")
#: Digits and signs written for letters.
_SIGNS = str.maketrans("013457@$+|", "oieastasti")
_FORMAT = re.compile("[­​-‏‪-‮⁠-⁤﻿\x00-\x08\x0e-\x1f]")
_MIXED = re.compile(r"[^\W\d_]*(?:[a-zà-ÿ][Ͱ-ӿԀ-ԯ]|[Ͱ-ӿԀ-ԯ][a-zà-ÿ])[^\W\d_]*")
_SIGNED = re.compile(r"(?<![\w@$+|])(?=[\w@$+|]*[a-zà-ÿ])[a-zà-ÿ0-9@$+|]*(?:[a-zà-ÿ][013457@$+|]|[013457@$+|][a-zà-ÿ])[a-zà-ÿ0-9@$+|]*(?![\w@$+|])")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .*_\-·])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_LONG = re.compile(r"([a-zà-ÿ])\1{2,}")
_HAN = "぀-ヿ㐀-鿿"
_PARTED = re.compile(rf"(?<=[{_HAN}])[ *_.·\-]+(?=[{_HAN}])")
_MASKED = re.compile(r"(?<![\w*])[a-zà-ÿ]+\*{2,}[a-zà-ÿ]*(?![\w*])")
_HAN_ANY = re.compile(f"[{_HAN}]")
_ENDS = frozenset(".!?。！？．।؟\n\r")
_THAI = "ก-ฺเ-๎"
_TOKENS = re.compile(
    rf"[{_HAN}]|\x02[^\W\d_]+|[เ-ไ]?[ก-ฮ][ะ-ฺๅ-๎]*|[^\W_{_HAN}{_THAI}@$+|](?:[^\W_{_HAN}{_THAI}]|[@$+|̀-ًͯ-ٟऀ-෿])*"
    rf"|[@$+|]+[^\W_{_HAN}](?:[^\W_{_HAN}]|[@$+|])*|\x01|[.!?。！？．।؟\n\r]"
)



def _word(raw: str) -> str:
    """One token with look-alike letters, letters written as signs and drawn-out letters undone; a number is "0"."""
    if raw.isdigit():
        return "0"
    raw = raw.lstrip("\x02")
    word = _MIXED.sub(lambda m: m[0].translate(_LOOKALIKES), raw)
    word = _SIGNED.sub(lambda m: m[0].translate(_SIGNS), word)
    return _LONG.sub(r"\1", word.strip("@$+|"))


def tokens(text: str) -> list[str]:
    """Raw tokens of the whole text, with spaced (after a mark), parted and masked words undone; "\\n" ends a passage."""
    text = _FORMAT.sub("", text)
    text = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    if _HAN_ANY.search(text):
        text = _PARTED.sub("", text)
    if "**" in text:
        text = _MASKED.sub(" \x01 ", text)
    if "_" in text:
        text = text.replace("_", " ")
    return _TOKENS.findall(_SPACED.sub(lambda m: "\x02" + "".join(c for c in m[0] if c.isalpha()), text))


class _Words(dict):
    """Tokens with disguises undone by raw token; "\n" ends a passage."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 1_000_000:
            self.clear()
        word = self[raw] = "\n" if raw[0] in _ENDS else _word(raw)
        return word


_words = _Words()


def plain(text: str) -> str:
    """The tokens of a text, disguises undone, one space between them; a line for each passage."""
    return re.sub(r"(?: ?\n ?)+", "\n", " ".join(map(_words.__getitem__, tokens(text)))).strip("\n")


class _Stream:
    """Token numbers of passages, one after another, with the document of each passage."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, docs: np.ndarray):
        self.ids, self.starts, self.docs = ids, starts, docs
        self.sizes = np.diff(np.append(starts, len(ids)))

    @classmethod
    def of(cls, marked: np.ndarray, ends: np.ndarray) -> _Stream:
        """From numbers with -1 after each passage, and the places where documents end."""
        stop = marked < 0
        first = np.flatnonzero(~stop & np.concatenate([[True], stop[:-1]]) if len(marked) else stop)
        return cls(marked[~stop], (np.cumsum(~stop) - 1)[first], np.searchsorted(ends, first, side="right"))

    def part(self, keep: np.ndarray) -> _Stream:
        """The passages for which ``keep`` holds."""
        sizes = self.sizes[keep]
        return _Stream(self.ids[np.repeat(keep, self.sizes)], np.cumsum(sizes) - sizes, self.docs[keep])

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens two and one before each token; 1 where the passage has none."""
        b = np.concatenate([[1], self.ids[:-1]])[: len(self.ids)]
        b[self.starts] = 1
        a = np.concatenate([[1], b[:-1]])[: len(self.ids)]
        a[self.starts] = 1
        return a, b

    def best(self, values: np.ndarray) -> np.ndarray:
        """For each passage the greatest mean of ``values`` over windows of ``WINDOW`` tokens; a shorter one counts as at least 4."""
        if not len(self.starts):
            return np.zeros(0)
        short = np.add.reduceat(values, self.starts) / np.maximum(4, self.sizes)
        padded = np.concatenate([values, np.zeros(WINDOW)])
        sums = sum(padded[k : k + len(values)] for k in range(WINDOW))
        sums[np.arange(len(values)) + WINDOW > np.repeat(self.starts + self.sizes, self.sizes)] = -np.inf
        return np.where(self.sizes > WINDOW, np.maximum.reduceat(sums, self.starts) / WINDOW, short)

    def by_document(self, best: np.ndarray, n: int) -> np.ndarray:
        """The greatest of a document's passages, 0 at least."""
        out = np.zeros(n)
        np.maximum.at(out, self.docs, best)
        return out


class KneserNey:
    """Interpolated Kneser-Ney trigrams over token numbers below ``size``; 0 is the unknown token, 1 the start."""

    def __init__(self, stream: _Stream, size: int, discount: float = 0.75):
        a, b = stream.before()
        self.triples, n = np.unique((a * size + b) * size + stream.ids, return_counts=True)
        self.pairs, kinds = np.unique(self.triples % (size * size), return_counts=True)
        ones = np.bincount(self.pairs % size, minlength=size)
        whole = ones.sum()
        self.one = (np.maximum(ones - discount, 0) + discount * np.count_nonzero(ones) / size) / whole if whole else np.full(size, 1 / size)
        # After a token: the discounted share of each pair, and what is left to the shorter context (all where nothing is known).
        first = self.pairs // size
        sums = np.bincount(first, weights=kinds, minlength=size)
        self.pair_share = (kinds - discount) / sums[first]
        self.pair_rest = np.where(sums > 0, discount * np.bincount(first, minlength=size) / np.maximum(sums, 1), 1.0)
        # The same after two tokens.
        self.contexts, at, where, spread = np.unique(self.triples // size, return_index=True, return_inverse=True, return_counts=True)
        sums = np.add.reduceat(n, at) if len(at) else np.zeros(0)
        self.triple_share = (n - discount) / sums[where]
        self.triple_rest = discount * spread / sums


def _spread(keys: np.ndarray, own: np.ndarray, values: np.ndarray, missing: float) -> np.ndarray:
    """``values`` of ``own`` at their places in the sorted ``keys``, and a last place for what is in none."""
    out = np.full(len(keys) + 1, missing)
    out[np.searchsorted(keys, own)] = values
    return out


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of ``wanted`` stands in the sorted ``keys``; their number where it does not."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


class Scorer:
    """The two models over one table of n-grams."""

    def __init__(self, abusive: KneserNey, ordinary: KneserNey):
        both = (abusive, ordinary)
        self.size = len(abusive.one)
        self.pairs = np.union1d(np.union1d(abusive.pairs, ordinary.pairs), np.union1d(abusive.contexts, ordinary.contexts))
        self.triples = np.union1d(abusive.triples, ordinary.triples)
        self.one = [m.one for m in both]
        self.pair_rest = [m.pair_rest for m in both]
        self.pair_share = [_spread(self.pairs, m.pairs, m.pair_share, 0.0) for m in both]
        self.triple_rest = [_spread(self.pairs, m.contexts, m.triple_rest, 1.0) for m in both]
        self.triple_share = [_spread(self.triples, m.triples, m.triple_share, 0.0) for m in both]

    def differences(self, stream: _Stream) -> np.ndarray:
        """Abusive less ordinary log-probability of every token."""
        (a, b), c, size = stream.before(), stream.ids, self.size
        pair, context = _places(self.pairs, b * size + c), _places(self.pairs, a * size + b)
        triple = np.full(len(c), len(self.triples))
        known = np.flatnonzero((context < len(self.pairs)) & (pair < len(self.pairs)))
        triple[known] = _places(self.triples, (a[known] * size + b[known]) * size + c[known])
        p = [
            self.triple_share[k][triple] + self.triple_rest[k][context] * (self.pair_share[k][pair] + self.pair_rest[k][b] * self.one[k][c])
            for k in range(2)
        ]
        return np.log(p[0] / p[1])

    def best(self, stream: _Stream) -> np.ndarray:
        return stream.best(self.differences(stream))


class _Numbers(dict):
    """Token numbers by raw token: -1 ends a passage, -2 is nothing."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        word = _word(raw)
        if raw[0] == "\x02" and word not in self.vocabulary and word[1:] in self.vocabulary:
            # A word of one letter stood before the spaced one.
            word = word[1:]
        number = -1 if raw[0] in _ENDS else self.vocabulary.get(word, 0) if word else -2
        if len(self) > 1_000_000:
            self.clear()
        self[raw] = number
        return number


class Model:
    """The two models, the vocabulary, the difference that is a score of 1, and how held-out labels fare with it."""

    def __init__(self, vocabulary: dict[str, int], scorer: Scorer | None, threshold: float = np.inf, precision: float | None = None, recall: float | None = None):
        self.vocabulary, self.scorer, self.threshold, self.precision, self.recall = vocabulary, scorer, threshold, precision, recall
        self.numbers = _Numbers(vocabulary)

    def __reduce__(self):
        return Model, (self.vocabulary, self.scorer, self.threshold, self.precision, self.recall)

    def scores(self, texts: list[str | None]) -> list[float | None]:
        """The greatest difference of a passage of each text in units of the threshold, 0 at least; null for null."""
        out: list[float | None] = []
        ids, ends, numbers = array("q"), [], self.numbers.__getitem__

        def flush() -> None:
            marked = np.frombuffer(ids, np.int64) if ids else np.zeros(0, np.int64)
            # A document's end moves back by the signs before it that are nothing.
            nothing = marked == -2
            at = np.asarray(ends, np.int64)
            at = at - np.concatenate([[0], np.cumsum(nothing)])[at] if len(at) else at
            stream = _Stream.of(marked[~nothing], at)
            found = stream.by_document(self.scorer.best(stream) if self.scorer and len(stream.ids) else np.zeros(len(stream.starts)), len(ends))
            out.extend((found / self.threshold).tolist())

        for text in texts:
            if text:
                ids.extend(map(numbers, tokens(text)))
            ids.append(-1)
            ends.append(len(ids))
            if len(ids) > BATCH:
                flush()
                ids, ends = array("q"), []
        flush()
        return [None if t is None else s for t, s in zip(texts, out)]

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _pair_weights(pairs: np.ndarray, docs: np.ndarray, abusive: np.ndarray) -> np.ndarray:
    """For each pair of tokens in a document, how surely other documents labelled abusive favour it over the ordinary ones.

    That is the log-likelihood ratio of its shares of documents of either kind, the document itself left out.
    """
    _, pairs = np.unique(pairs, return_inverse=True)
    seen = np.unique(docs * (pairs.max(initial=0) + 1) + pairs)
    of, doc = seen % (pairs.max(initial=0) + 1), seen // (pairs.max(initial=0) + 1)
    high, low = (np.bincount(of[abusive[doc] == kind], minlength=pairs.max(initial=0) + 1) for kind in (True, False))
    bad = abusive[docs]
    n, m, every, rest = high[pairs] - bad, low[pairs] - ~bad, abusive.sum() - bad, (~abusive).sum() - ~bad
    pooled = (n + m) / np.maximum(1, every + rest)

    def surplus(k: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(total * pooled, 1e-12)), 0.0)

    return np.where(n * rest > m * every, np.maximum(0.0, surplus(n, every) + surplus(m, rest)), 0.0)


def _cut(scores: np.ndarray, abusive: np.ndarray) -> tuple[float, float, float, float]:
    """(middle, greatest, precision, recall) of the thresholds whose F1 is within a hundredth of the best; the last two are the middle's."""
    values = np.unique(np.append(scores, 0.0))
    good, bad = np.sort(scores[abusive]), np.sort(scores[~abusive])
    # A threshold above one value and up to the next tells the same documents.
    true, false = len(good) - np.searchsorted(good, values[1:]), len(bad) - np.searchsorted(bad, values[1:])
    f1 = 2 * true / (len(good) + true + false)
    if not true.any():
        return np.inf, np.inf, 0.0, 0.0
    near = np.flatnonzero(f1 >= f1.max() * 0.99)
    middle, greatest = (values[near[0]] + values[near[-1] + 1]) / 2, values[near[-1] + 1]
    true, false = int((good >= middle).sum()), int((bad >= middle).sum())
    return float(middle), float(greatest), true / max(1, true + false), true / len(good)


def fitted(abusive: list[str], ordinary: list[str]) -> Model:
    """A model from texts labelled as a whole."""
    return _fitted([plain(t) for t in abusive], [plain(t) for t in ordinary])


def _fitted(held: list[str], usual: list[str]) -> Model:
    """A model from :func:`plain` texts; without texts of both kinds every score is 0."""
    rows = [*held, *usual]
    spread = Counter(t for row in rows for t in set(row.split()))
    vocabulary = {t: i + 2 for i, t in enumerate(sorted(t for t, n in spread.items() if n > 2))}
    flags = np.arange(len(rows)) < len(held)
    if not held or not usual:
        return Model(vocabulary, None)
    size, number = len(vocabulary) + 2, vocabulary.get
    marked = array("q")
    ends = []
    for row in rows:
        for line in row.split("\n"):
            marked.extend(number(t, 0) for t in line.split())
            marked.append(-1)
        ends.append(len(marked))
    stream = _Stream.of(np.frombuffer(marked, np.int64), np.asarray(ends))
    bad, own_fold = flags[stream.docs], stream.docs % FOLDS
    _, before = stream.before()
    weights = _pair_weights(before * size + stream.ids, np.repeat(stream.docs, stream.sizes), flags)
    best = stream.best(weights)
    ordinary = ~bad
    for _ in range(ROUNDS):
        # A passage is chosen if few ordinary documents have one that looks as abusive.
        top = np.full(len(flags), -np.inf)
        np.maximum.at(top, stream.docs, best)
        chosen = bad & (best > np.quantile(top[~flags], 1 - CHANCE, method="lower"))
        if not chosen.any():
            chosen = bad & (best >= best[bad].max(initial=-np.inf))
        best = np.zeros(len(best))
        for out in range(FOLDS):
            own = own_fold == out
            scorer = Scorer(KneserNey(stream.part(chosen & ~own), size), KneserNey(stream.part(ordinary & ~own), size))
            best[own] = scorer.best(stream.part(own))
        threshold, sure, precision, recall = _cut(stream.by_document(best, len(flags)), flags)
        # Ordinary documents too are labelled wrongly now and then: what held-out models surely find abusive teaches nothing.
        ordinary = ~bad & (best < sure)
    scorer = Scorer(KneserNey(stream.part(chosen), size), KneserNey(stream.part(ordinary), size))
    if threshold == np.inf:
        # Too few labels for any to be told when held out: the models' own documents tell.
        threshold = _cut(stream.by_document(scorer.best(stream), len(flags)), flags)[0]
    return Model(vocabulary, scorer, threshold if threshold < np.inf else 1.0, precision, recall)


def trained(documents: DataFrame, labels: DataFrame, limit: int = TRAINING_DOCUMENTS, most: int = TRAINING_CODE_POINTS) -> Model:
    """A model from at most ``limit`` documents labelled abusive and as many others, chosen by hash.

    Of either kind texts of at most ``most`` code points together are taken, in
    the order of the hash; one that no longer fits is passed over. A document is
    abusive when more than half of its raters say so; repeated labels of one
    rater count once, null ones not.
    """
    votes = labels.where("toxic is not null and doc_id is not null").select("doc_id", "rater_id", "toxic").distinct().groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    votes = votes.select("doc_id", (F.col("share") > 0.5).alias("abusive"), F.xxhash64("doc_id").alias("place"))
    chosen = None
    for kind in (True, False):
        part = votes.where(F.col("abusive") == kind).orderBy("place", "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    own = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sizes = own.select("doc_id", "abusive", "place", F.length("text").alias("n")).dropDuplicates(["doc_id"]).collect()
    left, taken = {True: most, False: most}, []
    for r in sorted(sizes, key=lambda r: (r.place, r.doc_id)):
        if r.n <= left[r.abusive]:
            left[r.abusive] -= r.n
            taken.append((r.doc_id,))
    if not taken:
        return _fitted([], [])
    wanted = documents.sparkSession.createDataFrame(taken, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["text"] = [plain(t) for t in frame["text"]]
            yield frame

    own = own.join(F.broadcast(wanted), "doc_id")
    rows = own.mapInPandas(run, own.schema).collect()
    rows.sort(key=lambda r: (r.place, r.doc_id, r.text))
    return _fitted([r.text for r in rows if r.abusive], [r.text for r in rows if not r.abusive])


def scores(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, source, score, abusive)`` for every row of ``documents``.

    The score is the greatest length-normalised log-likelihood difference over the text's passages, 0 at least,
    in units of the one that parts held-out labels best (``THRESHOLD`` is 1); a null text has a null score and is not abusive, an empty one scores 0. The whole
    text counts, however long; repeated rows stay as they are, and other columns are not read.
    Without documents labelled abusive and others every score is 0 and none counts as abusive.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model or trained(documents, labels))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for frame in frames:
            found = own.scores([t if isinstance(t, str) else None for t in frame["text"]])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "source": frame["source"], "score": pd.array(found, "Float64"), "abusive": [s is not None and s >= THRESHOLD for s in found]})

    return documents.select("doc_id", "source", "text").mapInPandas(run, f"doc_id {kind}, source string, score double, abusive boolean")
