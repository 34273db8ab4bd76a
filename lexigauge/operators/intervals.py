"""Interval algebra over code-point ranges of one source each.

Tables of intervals have ``doc_id, start, end`` (half open, not empty). Joins
always carry the document key, so they are hash joins with a range filter.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .surface import quantile


def _order():
    return Window.partitionBy("doc_id").orderBy("start", "end")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def invalid(intervals: DataFrame, sources: DataFrame) -> DataFrame:
    """``(doc_id, n_bad)``: intervals that are empty, outside the source, or overlap the one before; ``sources`` has ``doc_id, length``."""
    seen = intervals.withColumn("before", F.max("end").over(_before())).join(sources, "doc_id", "left")
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("start") >= F.col("end")) | F.col("length").isNull() | (F.col("end") > F.col("length")) | (F.col("start") < F.col("before"))
    return seen.groupBy("doc_id").agg(F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias("n_bad"))


def components(intervals: DataFrame) -> DataFrame:
    """``(doc_id, component, start, end)``: touching intervals merged, others apart."""
    new = F.coalesce((F.col("start") != F.lag("end").over(_order())).cast("int"), F.lit(1))
    island = F.sum("new").over(_order().rowsBetween(Window.unboundedPreceding, 0))
    return intervals.withColumn("new", new).withColumn("component", (island - 1).cast("long")).groupBy("doc_id", "component").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def gaps(intervals: DataFrame, sources: DataFrame) -> DataFrame:
    """``(doc_id, start, end)``: what no interval covers, the tail included; intervals may overlap."""
    reach = F.coalesce(F.max("end").over(_before()), F.lit(0).cast("long"))
    inner = intervals.select("doc_id", reach.alias("from"), F.col("start").alias("to"))
    last = intervals.groupBy("doc_id").agg(F.max("end").alias("from"))
    tail = sources.join(last, "doc_id", "left").select("doc_id", F.coalesce("from", F.lit(0).cast("long")).alias("from"), F.col("length").alias("to"))
    return inner.unionByName(tail).where(F.col("from") < F.col("to")).select("doc_id", F.col("from").alias("start"), F.col("to").alias("end"))


def partitions(targets: DataFrame, context: DataFrame, sources: DataFrame) -> DataFrame:
    """``(doc_id, is_partition)``: whether targets and context tile the whole source exactly."""
    every = targets.select("doc_id", "start", "end").unionByName(context.select("doc_id", "start", "end"))
    joints = every.withColumn("due", F.coalesce(F.lag("end").over(_order()), F.lit(0).cast("long")))
    per_doc = joints.groupBy("doc_id").agg(F.min(F.col("start") == F.col("due")).alias("joined"), F.max("end").alias("reach"))
    fits = F.when(F.col("joined").isNull(), F.col("length") == 0).otherwise(F.col("joined") & (F.col("reach") == F.col("length")))
    return sources.join(per_doc, "doc_id", "left").select("doc_id", fits.alias("is_partition"))


def selected(units: DataFrame, targets: DataFrame) -> DataFrame:
    """Units that meet a component of the targets: their columns, ``component`` and ``state`` ("complete" or "clipped").

    A unit inside one component is complete; one that only overlaps is clipped (once, without component).
    """
    own = components(targets).select("doc_id", "component", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    met = units.join(own, "doc_id").where((F.col("start") < F.col("c_end")) & (F.col("c_start") < F.col("end")))
    inside = (F.col("c_start") <= F.col("start")) & (F.col("end") <= F.col("c_end"))
    return met.groupBy(*units.columns).agg(F.max(F.when(inside, F.col("component"))).alias("component")).withColumn("state", F.when(F.col("component").isNull(), "clipped").otherwise("complete"))


def projected(paragraphs: DataFrame, sentences: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Surface features of the selected units only, one row per source.

    Units are those of the whole source (``paragraph``/``sentence``, ``start, end,
    chars``). Clipped paragraphs null F002 and F003, clipped sentences the rest. A
    pair of neighbours counts only when its whole span lies in one component;
    ranks are pooled over such pairs (three at least). F003 counts all of the
    source's sentences of a selected paragraph.
    """
    p, q = selected(paragraphs, targets), selected(sentences, targets)
    per_para = sentences.groupBy("doc_id", "paragraph").agg(F.count("*").alias("n"))
    pa = p.join(per_para, ["doc_id", "paragraph"], "left").groupBy("doc_id").agg(
        F.sum((F.col("state") == "complete").cast("long")).alias("paragraphs"), F.sum((F.col("state") == "clipped").cast("long")).alias("clipped_paragraphs"),
        F.sum(((F.col("state") == "complete") & (F.col("n") == 1)).cast("long")).alias("single"), F.sum(F.when(F.col("state") == "complete", F.col("chars"))).alias("paragraph_chars"),
    )
    order = Window.partitionBy("doc_id").orderBy("sentence")
    sa = q.groupBy("doc_id").agg(
        F.sum((F.col("state") == "complete").cast("long")).alias("sentences"), F.sum((F.col("state") == "clipped").cast("long")).alias("clipped_sentences"),
        F.sort_array(F.collect_list(F.when(F.col("state") == "complete", F.col("chars")))).alias("lens"),
    )
    whole = sentences.select("doc_id", "sentence", F.col("chars").alias("a"), F.lead("chars").over(order).alias("b"), F.col("start").alias("s"), F.lead("end").over(order).alias("e")).where("b is not null")
    own = components(targets).select("doc_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    pairs = whole.join(own, "doc_id").where("c_start <= s and e <= c_end").select("doc_id", "a", "b")

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy("doc_id").orderBy(c)) + (F.count("*").over(Window.partitionBy("doc_id", c)) - 1) / 2

    ra = pairs.select("doc_id", "a", "b", rank("a").alias("x"), rank("b").alias("y")).groupBy("doc_id").agg(
        F.count("*").alias("pairs"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("step"), F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("rho")
    )
    wide = sources.join(pa, "doc_id", "left").join(sa, "doc_id", "left").join(ra, "doc_id", "left").na.fill(0, ["paragraphs", "clipped_paragraphs", "single", "sentences", "clipped_sentences", "pairs"])
    wide = wide.withColumn("lens", F.coalesce("lens", F.array().cast("array<bigint>"))).withColumn("med", quantile(F.col("lens"), 0.5))
    off = F.sort_array(F.transform("lens", lambda n: F.abs(n - F.col("med"))))
    by_p, by_s = F.col("clipped_paragraphs") == 0, F.col("clipped_sentences") == 0
    value = {
        "f002": F.when(by_p, F.try_divide(F.lit(1000.0) * F.col("paragraphs"), F.col("paragraph_chars"))),
        "f003": F.when(by_p, F.try_divide(F.col("single").cast("double"), F.col("paragraphs"))),
        "f013": F.when(by_s, F.col("med")),
        "f014": F.when(by_s, quantile(F.col("lens"), 0.75) - quantile(F.col("lens"), 0.25)),
        "f015": F.when(by_s, quantile(F.col("lens"), 0.9)),
        "f016": F.when(by_s, F.try_divide(quantile(off, 0.5), F.col("med"))),
        "f024": F.when(by_s, F.try_divide(F.col("step"), F.col("med"))),
        "f025": F.when(by_s & (F.col("pairs") >= 3), F.col("rho")),
    }
    return wide.select("doc_id", "paragraphs", "clipped_paragraphs", "sentences", "clipped_sentences", "pairs", *((F.round(v, 9) + 0.0).alias(k) for k, v in value.items()))


def counters(sentences: DataFrame, targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Code points, components and neighbour pairs per source; the pair counters add up to all pairs."""
    own = components(targets)
    size = own.groupBy("doc_id").agg(F.count("*").alias("components"), F.sum(F.col("end") - F.col("start")).alias("target_codepoints"))
    order = Window.partitionBy("doc_id").orderBy("sentence")
    state = selected(sentences, targets).select("doc_id", "sentence", "component", "state")
    marked = sentences.select("doc_id", "sentence").join(state, ["doc_id", "sentence"], "left")
    nexts = marked.select("doc_id", F.coalesce("state", F.lit("excluded")).alias("s"), "component", F.lead(F.coalesce("state", F.lit("excluded"))).over(order).alias("t"), F.lead("component").over(order).alias("next")).where("t is not null")
    both = (F.col("s") == "complete") & (F.col("t") == "complete")
    clipped = (F.col("s") == "clipped") | (F.col("t") == "clipped")
    kinds = {
        "pairs_same_component": both & (F.col("component") == F.col("next")),
        "pairs_across_components": both & (F.col("component") != F.col("next")),
        "pairs_clipped": clipped,
        "pairs_with_excluded": ~both & ~clipped,
    }
    pairs = nexts.groupBy("doc_id").agg(F.count("*").alias("pairs"), *(F.sum(c.cast("long")).alias(k) for k, c in kinds.items()))
    out = sources.join(size, "doc_id", "left").join(pairs, "doc_id", "left").na.fill(0)
    return out.select("doc_id", F.col("length").alias("source_codepoints"), "target_codepoints", (F.col("length") - F.col("target_codepoints")).alias("excluded_codepoints"), "components", "pairs", *kinds)


def digest(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys, non-ASCII kept."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode("utf-8")).hexdigest()


def target_digests(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """``(doc_id, target_sha256, intervals_sha256)``: digests of the components' texts and of the intervals, in order."""
    own = components(targets).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = texts.select("doc_id", "text").where("text is not null").join(own, "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [[(int(x["start"]), int(x["end"])) for x in one] for one in frame["spans"]]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"],
                "target_sha256": [digest([t[a:b] for a, b in one]) for t, one in zip(frame["text"], spans)],
                "intervals_sha256": [digest([{"start": a, "end": b} for a, b in one]) for one in spans],
            })

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, target_sha256 string, intervals_sha256 string")
