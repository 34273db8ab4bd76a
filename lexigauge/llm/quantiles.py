"""Problem 2: percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers of at most ``k`` values, each value standing
for ``weight`` rows. Equal-size buffers of one level merge by selecting evenly
spaced positions of their weighted union; a collapse to weight W moves no rank
by more than W / 2, so the sum of W // 2 over all collapses bounds the error,
and each sketch carries that sum. Sketches of partitions or days combine into
sketches of their union.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded

PERCENTS = (1, 5, 25, 50, 75, 95, 99)
#: Values of a buffer.
BUFFER = 2048
_BUFFERS = "array<struct<level:int,weight:bigint,items:array<double>>>"


class Sketch:
    """Buffers by level; ``fan`` buffers of the lowest full level collapse into one of the next."""

    def __init__(self, k: int, fan: int = 8):
        self.k, self.fan, self.error, self.count = k, fan, 0, 0
        self.loose: list[np.ndarray] = []
        self.n_loose = 0
        self.levels: dict[int, list[tuple[int, np.ndarray]]] = {}

    def add(self, values: np.ndarray) -> None:
        """Add values of weight 1."""
        self.count += len(values)
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= self.k:
            every = np.concatenate(self.loose)
            whole = len(every) // self.k * self.k
            for i in range(0, whole, self.k):
                self._push(0, 1, np.sort(every[i : i + self.k]))
            self.loose, self.n_loose = [every[whole:]], len(every) - whole

    def merge(self, count: int, error: int, buffers: list[tuple[int, int, np.ndarray]]) -> None:
        """Add another sketch's content."""
        self.error += error
        before = self.count
        for level, weight, items in buffers:
            if level < 0:
                self.add(items)
            else:
                self._push(level, weight, items)
        self.count = before + count

    def _push(self, level: int, weight: int, items: np.ndarray) -> None:
        row = self.levels.setdefault(level, [])
        row.append((weight, items))
        if len(row) >= self.fan:
            self.levels[level] = []
            total, kept = self._collapse(row)
            self._push(level + 1, total, kept)

    def _collapse(self, row: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        total = sum(w for w, _ in row)
        items = np.concatenate([v for _, v in row])
        order = np.argsort(items, kind="stable")
        ranks = np.cumsum(np.concatenate([np.full(len(v), w, np.int64) for w, v in row])[order])
        wanted = np.arange(self.k, dtype=np.int64) * total + (total + 1) // 2
        self.error += total // 2
        return total, items[order][np.searchsorted(ranks, wanted)]

    def buffers(self) -> list[tuple[int, int, np.ndarray]]:
        """(level, weight, items); loose values have level -1."""
        out = [(-1, 1, np.concatenate(self.loose))] if self.n_loose else []
        return out + [(level, w, v) for level, row in sorted(self.levels.items()) for w, v in row]

    def quantile(self, percents: tuple[int, ...]) -> list[float | None]:
        """The value at rank ceil(percent * n / 100), within ``error`` ranks."""
        parts = self.buffers()
        if not parts:
            return [None] * len(percents)
        items = np.concatenate([v for _, _, v in parts])
        order = np.argsort(items, kind="stable")
        ranks = np.cumsum(np.concatenate([np.full(len(v), w, np.int64) for _, w, v in parts])[order])
        wanted = [max(1, -(-p * int(ranks[-1]) // 100)) for p in percents]
        return [float(x) for x in items[order][np.searchsorted(ranks, wanted)]]


def _rows(parts: dict, names: list[str]) -> pd.DataFrame:
    out = [(*key, s.count, s.error, [{"level": a, "weight": w, "items": v} for a, w, v in s.buffers()]) for key, s in parts.items()]
    return pd.DataFrame(out, columns=[*names, "n", "rank_error", "buffers"])


def sketches(rows: DataFrame, by: list[str], features: str = "features", k: int = BUFFER, most_open: int = 20_000) -> DataFrame:
    """Sketches per ``by`` and ``feature_id``: ``(by..., feature_id, part, n, rank_error, buffers)``, several per group.

    ``features`` is a map from feature id to value, ``by`` are string columns
    (null is a group of its own). Null and non-finite values are left out; a
    null or empty map gives nothing. Each task keeps at most ``most_open`` open
    sketches and gives them out when there are more. A group of any size is
    spread over all tasks.
    """
    narrow = rows.select(*by, features)
    names = [*by, "feature_id"]
    schema = ", ".join(f"`{c}` string" for c in names) + f", part int, n bigint, rank_error bigint, buffers {_BUFFERS}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        kinds = pa.schema([*((c, pa.string()) for c in names), ("part", pa.int32()), ("n", pa.int64()), ("rank_error", pa.int64()), ("buffers", pa.list_(pa.struct([("level", pa.int32()), ("weight", pa.int64()), ("items", pa.list_(pa.float64()))])))])
        kept: dict[tuple, Sketch] = {}

        def given() -> pa.RecordBatch:
            frame = _rows(kept, names)
            frame.insert(len(names), "part", part)
            return pa.RecordBatch.from_pandas(frame, schema=kinds, preserve_index=False)

        for batch in batches:
            maps = batch.column(len(by))
            sizes = np.diff(maps.offsets.to_numpy(zero_copy_only=False))
            sizes[maps.is_null().to_numpy(zero_copy_only=False)] = 0
            if not sizes.sum():
                continue
            keys = maps.keys.dictionary_encode()
            values = maps.items.to_numpy(zero_copy_only=False).astype(np.float64)
            first = maps.offsets[0].as_py()
            values, codes = values[first : first + sizes.sum()], keys.indices.to_numpy(zero_copy_only=False)[first : first + sizes.sum()]
            labels: dict[tuple, int] = {}
            owner = np.fromiter((labels.setdefault(x, len(labels)) for x in zip(*(batch.column(i).to_pylist() for i in range(len(by))))), np.int64, len(batch)) if by else np.zeros(len(batch), np.int64)
            groups = list(labels) or [()]
            cell = np.repeat(owner, sizes) * len(keys.dictionary) + codes
            fine = np.isfinite(values)
            cell, values = cell[fine], values[fine]
            order = np.argsort(cell, kind="stable")
            cell, values = cell[order], values[order]
            edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            features_here = keys.dictionary.to_pylist()
            for a, b in zip(edges, [*edges[1:], len(cell)]):
                g, f = divmod(int(cell[a]), len(features_here))
                key = (*groups[g], features_here[f])
                if key not in kept:
                    if len(kept) >= most_open:
                        yield given()
                        kept.clear()
                    kept[key] = Sketch(k)
                kept[key].add(values[a:b])
        if kept:
            yield given()

    return narrow.mapInArrow(run, schema)


def combine(parts: DataFrame, by: list[str], k: int = BUFFER, fan_in: int = 256, most_parts: int | None = None) -> DataFrame:
    """One sketch per ``by`` and ``feature_id`` from those of partitions, days or other finer groups.

    Merges go up a tree: a task merges at most about ``fan_in`` sketches of one
    group, whatever the number of parts, and each merged sketch is of bounded
    size. ``most_parts`` is the greatest number of sketches of one group (found by a count
    if not given).
    """
    names = [*by, "feature_id"]
    schema = ", ".join(f"`{c}` string" for c in names) + f", part int, n bigint, rank_error bigint, buffers {_BUFFERS}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total, part = None, None, 0

        def given() -> pd.DataFrame:
            out = _rows({last: total}, names)
            out.insert(len(names), "part", part)
            return out

        for frame in frames:
            done = []
            for row in frame.itertuples(index=False):
                key = tuple(None if x is None or x != x else x for x in row[: len(names)])
                if total is None or key != last:
                    if total is not None:
                        done.append(given())
                    last, total, part = key, Sketch(k), int(row.slot)
                total.merge(int(row.n), int(row.rank_error), [(int(b["level"]), int(b["weight"]), np.asarray(b["items"], np.float64)) for b in row.buffers])
            if done:
                yield pd.concat(done)
        if total is not None:
            yield given()

    out = parts.select(*names, "part", "n", "rank_error", "buffers")
    if most_parts is None:
        most_parts = out.groupBy(*names).count().agg(F.max("count")).first()[0] or 1
    slots = 2 ** math.ceil(math.log2(max(1, most_parts)))
    while True:
        slots = -(-slots // fan_in)
        slot = F.lit(0) if slots <= 1 else F.pmod(F.xxhash64("part", "n"), F.lit(slots))
        keys = [*names, "slot"]
        out = out.withColumn("slot", slot).repartition(*keys).sortWithinPartitions(*keys, "part", "n").mapInPandas(run, schema)
        if slots <= 1:
            return out


def percentiles(whole: DataFrame, by: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``(by..., feature_id, n, rank_error, pNN...)`` of combined sketches."""
    names = [*by, "feature_id"]
    columns = [f"p{p:02d}" for p in percents]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                one = Sketch(max(1, max((len(b["items"]) for b in row.buffers), default=1)), fan=1 << 30)
                for b in row.buffers:
                    one.levels.setdefault(int(b["level"]), []).append((int(b["weight"]), np.asarray(b["items"], np.float64)))
                out.append((*row[: len(names)], row.n, row.rank_error, *one.quantile(percents)))
            yield pd.DataFrame(out, columns=[*names, "n", "rank_error", *columns])

    schema = ", ".join(f"`{c}` string" for c in names) + ", n bigint, rank_error bigint, " + ", ".join(f"{c} double" for c in columns)
    return whole.mapInPandas(run, schema)


def once(observations: DataFrame) -> DataFrame:
    """Every id once, as first received: ``(source, condition, day, features)``.

    Sources are united without case and outer spaces. Of rows of one id the
    earliest received counts, ties in favour of the earlier measured, then of
    the lesser source and condition. Rows of a null id are kept, each for itself. ``day`` is the UTC day of
    ``measured_at``.
    """
    rows = observations.select(
        "id", folded(F.col("source")).alias("source"), "condition",
        F.date_format("measured_at", "yyyy-MM-dd").alias("day"), "features", "received_at", "measured_at",
    )
    kept = F.min_by(F.struct("source", "condition", "day", "features"), F.struct("received_at", "measured_at", "source", "condition"))
    named = rows.where("id is not null").groupBy("id").agg(kept.alias("r")).select("r.*")
    return named.unionByName(rows.where("id is null").select("source", "condition", "day", "features"))
