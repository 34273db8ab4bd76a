"""Problem 7: passages of evaluation items inside corpus documents.

One Aho-Corasick automaton over the runs of twelve characters of all
normalised items, however many, scans each normalised document once; hits are counted per
item, and offsets are mapped back to the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normal import letters_digits, offsets

class _Automaton:
    """Runs of ``width`` characters of a block of items."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.ids, self.counts, owners = [], [], {}
        for item_id, text in items:
            plain = letters_digits(text)
            runs = {plain[i : i + width] for i in range(len(plain) - width + 1)} or ({plain} if plain else set())
            if runs:
                for run in runs:
                    owners.setdefault(run, []).append(len(self.ids))
                self.ids.append(item_id)
                self.counts.append(len(runs))
        self.scan = ahocorasick.Automaton()
        for k, run in enumerate(owners):
            self.scan.add_word(run, (k, len(run)))
        if owners:
            self.scan.make_automaton()
        lists = list(owners.values())
        self.first = np.cumsum([0, *map(len, lists)])
        self.owner = np.fromiter((x for own in lists for x in own), np.int64, int(self.first[-1]))
        self.needed = np.asarray(self.counts, np.int64)

    def held(self, text: str, share: float, where: bool) -> list[tuple]:
        """(item, runs found, runs, start, end) of the items of which at least ``share`` of the runs occur; if ``where``, for each of their passages."""
        if not self.ids:
            return []
        plain, places = letters_digits(text), None
        hits = [(e - n + 1, e + 1, k) for e, (k, n) in self.scan.iter(plain)]
        if not hits:
            return []
        found = np.bincount(np.concatenate([self.owner[self.first[k] : self.first[k + 1]] for k in {k for _, _, k in hits}]), minlength=len(self.ids))
        rows = []
        for i in np.flatnonzero((found > 0) & (found >= share * self.needed)):
            own = (self.ids[i], int(found[i]), int(self.needed[i]))
            if not where:
                rows.append((*own, None, None))
                continue
            if places is None:
                mapped, places = offsets(text)
                if mapped != plain:
                    hits = [(e - n + 1, e + 1, k) for e, (k, n) in self.scan.iter(mapped)]
            spans: list[list[int]] = []
            for a, b in sorted((a, b) for a, b, k in hits if i in self.owner[self.first[k] : self.first[k + 1]]):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            rows += [(*own, places[a], places[b - 1] + 1) for a, b in spans]
        return rows


_built: dict[str, _Automaton] = {}


def _automaton(items: list[tuple[int, str]], width: int) -> _Automaton:
    key = hashlib.sha256(repr((width, items)).encode("utf-8", "replace")).hexdigest()
    if key not in _built:
        if len(_built) > 1:
            _built.clear()
        _built[key] = _Automaton(items, width)
    return _built[key]


def held_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = 12, share: float = 0.5, where: bool = False,
) -> DataFrame:
    """``(doc_id, item_id, runs_found, runs, start_cp, end_cp)`` for every item a document holds.

    A document holds an item when at least ``share`` of the item's distinct runs
    of ``width`` letters and digits (NFKC, lower case) occur in it; an item
    shorter than that is one run. With ``where`` there is a row for each passage, a
    stretch of the text that the item's runs cover without a gap, and ``start_cp`` and
    ``end_cp`` bound it in the original text; else one row an item, and both are null. Null or letterless documents hold
    nothing; null or letterless items are held by nothing; repeated items count
    once, repeated documents each. Other columns are not read. The items are the
    stated query set: all go into one automaton, some 50 KB each, which every worker
    builds once, and the documents are scanned once.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    sent = spark.sparkContext.broadcast(sorted((r.i, r.t) for r in held.toLocalIterator()))
    narrow = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kind = narrow.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _automaton(sent.value, width)
        for frame in frames:
            rows = [(d, *hit) for d, t in zip(frame["doc_id"], frame["text"]) for hit in own.held(t, share, where)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "runs_found", "runs", "start_cp", "end_cp"])

    return narrow.mapInPandas(run, f"doc_id {kind}, item_id long, runs_found long, runs long, start_cp long, end_cp long")
