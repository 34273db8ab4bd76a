"""Files as byte-exact sources, checked against manifests, and sinks that never overwrite."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256, text)`` of whole files: strict UTF-8, byte order marks and line ends kept; malformed bytes fail."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def formats(files: DataFrame) -> DataFrame:
    """``files`` with ``format`` by suffix: latex, markdown, pdf, else text."""
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    return files.withColumn("format", F.when(suffix == ".tex", "latex").when(suffix == ".md", "markdown").when(suffix == ".pdf", "pdf").otherwise("text"))


def pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``(path, page, start, end, empty, text)`` of PDF pages, joined as by two line breaks; no character recognition.

    ``extract`` gives a file's page texts; without it the optional reader is used, and its absence fails.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        take = extract
        if take is None:
            import io

            from pypdf import PdfReader

            take = lambda raw: [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]
        for frame in frames:
            rows = [(path, n, t) for path, raw in zip(frame["path"], frame["content"]) for n, t in enumerate(take(raw), 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInPandas(run, "path string, page long, text string")
    order = Window.partitionBy("path").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(order), F.lit(0))
    return found.select("path", "page", start.cast("long").alias("start"), (start + F.length("text")).cast("long").alias("end"), (F.trim("text") == "").alias("empty"), "text")


def json_texts(files: DataFrame, schema: T.StructType) -> DataFrame:
    """``(path, value)`` of JSON files with an optional byte order mark; anything that does not fit the schema fails."""
    return files.select("path", F.from_json(F.regexp_replace("text", r"^\x{feff}", ""), schema, {"mode": "FAILFAST"}).alias("value"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a malformed one fails. Lines end at CR or LF only."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, sha256, state)``: "ok", "changed", "missing" from the files, or "unlisted" in the manifest (``name, sha256``)."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    both = manifest.select("name", F.col("sha256").alias("listed")).join(own, "name", "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") != F.col("listed"), "changed").otherwise("ok")
    return both.select("name", F.coalesce("found", "listed").alias("sha256"), state.alias("state"))


def write_json(df: DataFrame, path: str) -> None:
    """``df`` as JSON lines in a new folder; an existing one, or a value that is not finite, fails before anything is written."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    odd = F.lit(False)
    for c in numbers:
        odd = odd | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    if numbers and not df.where(odd).isEmpty():
        raise ValueError("values that are not finite have no JSON form")
    df.write.mode("errorifexists").json(path)


def write_receipt(value: dict, path: str) -> None:
    """A small JSON receipt in a new file: UTF-8, LF, no NaN; an existing file fails."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, allow_nan=False)
    with Path(path).open("x", encoding="utf-8", newline="\n") as out:
        out.write(text + "\n")


def write_cards(cards: dict[str, str], folder: str) -> dict[str, str]:
    """Managed Markdown files, written anew, and the SHA-256 of each by name."""
    import hashlib

    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, text in cards.items():
        Path(folder, name).write_text(text, encoding="utf-8", newline="\n")
    return {name: hashlib.sha256(text.encode("utf-8")).hexdigest() for name, text in cards.items()}
