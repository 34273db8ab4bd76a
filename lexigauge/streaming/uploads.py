"""Chunked uploads: pieces in any order become one text, once.

An identical piece again is ignored; another text under the same index, or other
metadata under the same upload, is an error, and so is a size beyond the limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CODE_POINTS, MOST_CHUNKS = 2_000_000, 1_000
_OUT = "upload_id string, state string, text string, sha256 string"
_STATE = "total int, format string, source string, idx array<int>, texts array<string>"


def assembled(chunks: DataFrame, most: int = MOST_CODE_POINTS) -> DataFrame:
    """``(upload_id, state, text, sha256)`` of a table of chunks ``(upload_id, idx, total, text, format, source)``.

    State: "complete", "incomplete", "conflict", "metadata", "index" or "too_large"; the text is null unless complete.
    """
    parts = chunks.select("upload_id", "idx", "total", "text", "format", "source").distinct()
    per = parts.groupBy("upload_id").agg(
        F.count("*").alias("n"), F.countDistinct("idx").alias("kinds"), F.countDistinct(F.struct("total", F.coalesce("format", F.lit("")), F.coalesce("source", F.lit("")))).alias("metas"),
        F.max("total").alias("total"), F.min("idx").alias("low"), F.max("idx").alias("high"), F.sum(F.length("text")).alias("size"),
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("x"),
    )
    state = (
        F.when(F.col("metas") > 1, "metadata").when((F.col("low") < 0) | (F.col("high") >= F.col("total")) | (F.col("total") > MOST_CHUNKS) | (F.col("total") < 1), "index")
        .when(F.col("n") > F.col("kinds"), "conflict").when(F.col("size") > most, "too_large").when(F.col("kinds") < F.col("total"), "incomplete").otherwise("complete")
    )
    text = F.when(F.col("state") == "complete", F.array_join("x.text", ""))
    return per.withColumn("state", state).select("upload_id", "state", text.alias("text")).withColumn("sha256", F.sha2("text", 256))


def stream(chunks: DataFrame, most: int = MOST_CODE_POINTS, patience: str | None = None) -> DataFrame:
    """The same over a stream of chunks; an upload's row comes out once, and its state is then dropped.

    ``patience`` (such as "1 hour") is our own limit after which an upload without news ends as "incomplete".
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        def done(kind: str, text: str | None = None) -> pd.DataFrame:
            state.remove()
            digest = None if text is None else hashlib.sha256(text.encode("utf-8")).hexdigest()
            return pd.DataFrame([(key[0], kind, text, digest)], columns=["upload_id", "state", "text", "sha256"])

        if state.hasTimedOut:
            yield done("incomplete")
            return
        total, kind, source, idx, texts = state.get if state.exists else (None, None, None, [], [])
        held = dict(zip(idx, texts))
        for frame in frames:
            for row in frame.itertuples(index=False):
                own = (int(row.total), row.format, row.source)
                if total is None:
                    total, kind, source = own
                if own != (total, kind, source):
                    yield done("metadata")
                    return
                if not 0 <= row.idx < total <= MOST_CHUNKS:
                    yield done("index")
                    return
                if held.setdefault(int(row.idx), row.text) != row.text:
                    yield done("conflict")
                    return
        if sum(map(len, held.values())) > most:
            yield done("too_large")
        elif len(held) == total:
            yield done("complete", "".join(held[i] for i in range(total)))
        else:
            state.update((total, kind, source, list(held), list(held.values())))
            if patience:
                state.setTimeoutDuration(int(pd.Timedelta(patience).total_seconds() * 1000))

    timeout = "ProcessingTimeTimeout" if patience else "NoTimeout"
    return chunks.select("upload_id", "idx", "total", "text", "format", "source").groupBy("upload_id").applyInPandasWithState(step, _OUT, _STATE, "append", timeout)
