"""Problem 1: the same or near-same records across splits.

The n-gram hashes of evaluation and training records are partitioned: of each
record the least hashes under some hundred orders are taken, four at a time, and
records that agree in such a four meet. One bit of each least hash makes a
sketch; only where two sketches differ no more than similar sets' can is a meeting
a hit. For every hit the containment of the evaluation record is computed from the
whole n-gram sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded, known_id
from ..sources.tables import cut
from .normal import letters_digits, lettered, run_hashes

#: Least hashes taken together, and how many such fours. Two sets that share a part j of their union miss each other with a
#: probability of (1 - j ** FOUR) ** BANDS: 2e-7 at 0.68, 1e-4 at 0.6, and meet by chance with one of 4e-4 at 0.05.
FOUR, BANDS = 4, 64
#: Bits of two sketches that agree at least. Each of the 256 agrees with a probability of (1 + j) / 2: fewer do with one of 3e-9 at 0.68, 3e-5 at
#: 0.6, and as many with one of 6e-6 at 0.12, where most meetings by chance are (they grow as the square of the table).
AGREE = 178
#: Rows on one side of a block of a join; keys with more rows are split into blocks that meet each other.
BLOCK = 2000
#: A key counts as hot if it holds one of this many parts of all rows, so that the table of hot keys stays small.
HOT_PARTS = 4096


def split_flags(observations: DataFrame) -> DataFrame:
    """``(key, train, evaluation, eval_split, source)`` per folded observation id.

    Splits are compared without case and outer spaces; null is no split. An id
    with several observations takes the part of each; ``eval_split`` and
    ``source`` are then the least of the evaluation rows'.
    """
    split = F.upper(folded(F.col("split")))
    rows = observations.select(folded(F.col("id")).alias("key"), split.alias("s"), folded(F.col("source")).alias("source")).where("key is not null and s in ('TRAIN', 'DEV', 'TEST')")
    held = F.col("s") != "TRAIN"
    return rows.groupBy("key").agg(
        F.max(~held).alias("train"), F.max(held).alias("evaluation"), F.min(F.when(held, F.struct("s", "source"))).alias("e"),
    ).select("key", "train", "evaluation", F.col("e.s").alias("eval_split"), F.col("e.source").alias("source"))


def _orders() -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and masks that each make one order of hashes."""
    make = np.random.Generator(np.random.PCG64(20240229))
    return make.integers(0, 1 << 32, FOUR * BANDS, np.uint32) | np.uint32(1), make.integers(0, 1 << 32, FOUR * BANDS, np.uint32)


_ORDERS = _orders()


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes' upper halves in each order."""
    factors, masks = _ORDERS
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    least, room = np.full(FOUR * BANDS, np.iinfo(np.uint32).max, np.uint32), np.empty((64, FOUR * BANDS), np.uint32)
    for k in range(0, len(upper), len(room)):
        part = room[: min(len(room), len(upper) - k)]
        np.bitwise_xor(upper[k : k + len(room), None], masks, out=part)
        np.multiply(part, factors, out=part)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of n-gram hashes; sets that have any of them in common may be similar."""
    return _keys(least_hashes(hashes)[None])[0]


def _keys(least: np.ndarray) -> np.ndarray:
    """The keys of each row of least hashes."""
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS))
    for k in range(FOUR):
        keys = (keys ^ least.reshape(-1, BANDS, FOUR)[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.astype(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """The sketch of each row of least hashes: one bit of each, mixed so that it tells nothing but which hash it is; four 64-bit numbers."""
    mixed = least ^ (least >> np.uint32(16))
    mixed = mixed * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(13)
    mixed = mixed * np.uint32(0xC2B2AE35)
    return np.packbits((mixed >> np.uint32(31)).astype(bool), axis=1).view(np.int64)


def _block_join(held: DataFrame, trained: DataFrame, keys: list[str], hot: DataFrame, held_id: str, trained_id: str) -> DataFrame:
    """``held`` joined with ``trained`` on ``keys``; rows of ``hot`` keys (``keys``, ``n``) meet in blocks, so that no task holds them all."""
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("n") / BLOCK).alias("blocks")))

    def side(df: DataFrame, own_id: str, mine: str, other: str) -> DataFrame:
        blocks = F.coalesce(F.col("blocks"), F.lit(1).cast("long"))
        return df.join(hot, keys, "left").withColumn(mine, F.pmod(F.xxhash64(own_id), blocks)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).drop("blocks")

    return side(held, held_id, "eb", "tb").join(side(trained, trained_id, "tb", "eb"), [*keys, "eb", "tb"]).drop("eb", "tb")


def near_pairs(classes: DataFrame, width: int = 5, share: float = 0.6) -> DataFrame:
    """``(class_e, class_t, both, n_e, n_t)``: classes of equal texts that are nearly the same across sides.

    ``classes`` has one row a ``class``, with its ``plain`` text (letters and digits only) and the flags ``train`` and
    ``evaluation``. The similarity is the share of distinct runs of ``width`` characters found in either text that are found
    in both; a shorter text is one run. ``both`` / ``n_e`` is the containment of the evaluation text in the training text.
    """
    own = classes.select("class", "plain", "train", "evaluation", F.xxhash64("class").alias("c"))

    bits = [f"s{k}" for k in range(FOUR * BANDS // 64)]

    def banded(batches):
        for batch in batches:
            least = np.array([least_hashes(run_hashes(plain, width)) for plain in batch.column("plain").to_pylist()], np.uint32).reshape(-1, FOUR * BANDS)
            keys, sketch = _keys(least), sketches(least)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in flags), *(np.ascontiguousarray(x) for x in sketch.T), listed], [*flags, *bits, "keys"])

    flags = ["c", "train", "evaluation"]
    rows = cut(own.select("plain", *flags).mapInArrow(banded, f"c long, train boolean, evaluation boolean, {', '.join(f'{b} long' for b in bits)}, keys array<long>"), "bands")
    keyed = rows.select(*flags, *bits, F.explode("keys").alias("key"))
    # Hot keys are looked for in a sixteenth of the classes: it decides only how the join is split.
    part = rows.where(F.pmod(F.col("c"), F.lit(16)) == 0)
    least = max(BLOCK // 16, part.count() // HOT_PARTS)
    hot = part.select(F.explode("keys").alias("key")).groupBy("key").agg((F.count("*") * 16).alias("n")).where(F.col("n") >= 16 * least)

    def side(flag: str, tag: str) -> DataFrame:
        return keyed.where(flag).select("key", F.col("c").alias(tag), *(F.col(b).alias(f"{b}_{tag}") for b in bits))

    met = _block_join(side("evaluation", "e"), side("train", "t"), ["key"], hot, "e", "t")
    # This stands in the join's own condition, so that meetings by chance are never written.
    differ = sum((F.bit_count(F.col(f"{b}_e").bitwiseXOR(F.col(f"{b}_t"))) for b in bits), F.lit(0))
    met = cut(met.where((F.col("e") != F.col("t")) & (differ <= FOUR * BANDS - AGREE)).select("e", "t").distinct(), "hits")

    def texts(tag: str) -> DataFrame:
        wanted = met.select(F.col(tag).alias("c")).distinct()
        return own.join(wanted, "c", "left_semi").select(F.col("c").alias(tag), F.col("class").alias(f"class_{tag}"), F.col("plain").alias(f"plain_{tag}"))

    def measured(frames):
        known: dict[str, np.ndarray] = {}

        def grams(plain: str) -> np.ndarray:
            if plain not in known:
                if len(known) > 1000:
                    known.clear()
                known[plain] = run_hashes(plain, width)
            return known[plain]

        for frame in frames:
            out = []
            for e, t, a, b in zip(frame["class_e"], frame["class_t"], frame["plain_e"], frame["plain_t"]):
                x, y = grams(a), grams(b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= share * (len(x) + len(y) - both) - 1e-9:
                    out.append((e, t, both, len(x), len(y)))
            yield pd.DataFrame(out, columns=["class_e", "class_t", "both", "n_e", "n_t"])

    both = met.join(texts("e"), "e").join(texts("t"), "t").where("class_e <> class_t").select("class_e", "class_t", "plain_e", "plain_t")
    return both.mapInPandas(measured, "class_e string, class_t string, both long, n_e long, n_t long")


def _members(documents: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with class, groups, sides and plain text; one row of plain text a class)."""
    docs = documents.select(
        F.col("document_id").alias("doc"), folded(F.col("document_id")).alias("key"), "text",
        known_id(F.col("leakage.content_group_id")).alias("content"), known_id(F.col("leakage.near_duplicate_group_id")).alias("near"),
    ).where("doc is not null").join(split_flags(observations), "key")

    def plain(frames):
        for frame in frames:
            texts = [letters_digits(t) if t else "" for t in frame["text"]]
            frame["plain"] = [t if lettered(t) else None for t in texts]
            yield frame.drop(columns="text")

    made = docs.select("doc", "text", "content", "near", "train", "evaluation", "eval_split", "source").mapInPandas(
        plain, "doc string, content string, near string, train boolean, evaluation boolean, eval_split string, source string, plain string"
    )
    made = cut(made.withColumn("class", F.sha2("plain", 256)), "documents")
    classes = made.where("class is not null").groupBy("class").agg(F.first("plain").alias("plain"), F.max("train").alias("train"), F.max("evaluation").alias("evaluation"))
    return made.drop("plain").distinct(), classes


_KINDS = (("content_group", "content"), ("near_duplicate_group", "near"), ("text", "class"))


def _grouped(members: DataFrame) -> DataFrame:
    """A row for each group that a document declares, and for its class of equal texts."""
    group = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(c).alias("value")) for kind, c in _KINDS))).alias("g")
    return members.select("doc", "train", "evaluation", "eval_split", "source", group).select("doc", "train", "evaluation", "eval_split", "source", "g.kind", "g.value").where("value is not null")


def _hot(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The keys with so many rows that they are split; at most some ``HOT_PARTS`` of them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > max(BLOCK, total // HOT_PARTS))


def leaks(documents: DataFrame, observations: DataFrame, width: int = 5, share: float = 0.6) -> DataFrame:
    """``(id_a, id_b, eval_split, source, kinds, containment)``: pairs of document ids over the border of TRAIN and evaluation.

    A pair shares a ``content_group_id`` or ``near_duplicate_group_id`` (without
    case and outer white space; stand-ins for "not known" are no group), or has
    the same or nearly the same text (see :func:`near_pairs`; texts without a
    letter, null ones included, never count). Repeated documents count once; a null id is
    no document. ``kinds`` tells which rules hold, ``id_a < id_b``, each pair
    once, with the evaluation record's split and source (the lesser where both ids are on either side).
    ``containment`` is the part of the evaluation text's n-grams that stand in
    the training text, null where only a group was declared (the greater where both ids are on either side).
    """
    members, classes = _members(documents, observations)
    members = cut(members, "members")
    grouped, total = _grouped(members), members.count()
    held = grouped.where("evaluation").select("kind", "value", F.col("doc").alias("e"), "eval_split", "source")
    trained = grouped.where("train").select("kind", "value", F.col("doc").alias("t"))
    same = _block_join(held, trained, ["kind", "value"], _hot(grouped, ["kind", "value"], total), "e", "t")
    same = same.select("e", "t", "eval_split", "source", "kind", F.when(F.col("kind") == "text", F.lit(1.0)).alias("containment"))

    close = near_pairs(classes, width, share).select("class_e", "class_t", (F.col("both") / F.col("n_e")).alias("containment"))
    by_class = members.where("class is not null")
    hot = _hot(by_class, ["class"], total)
    held = by_class.where("evaluation").select(F.col("class").alias("class_e"), F.col("doc").alias("e"), "eval_split", "source")
    trained = by_class.where("train").select(F.col("class").alias("class_t"), F.col("doc").alias("t"))
    nearly = _block_join(close, held, ["class_e"], hot.withColumnRenamed("class", "class_e"), "class_t", "e")
    nearly = _block_join(nearly, trained, ["class_t"], hot.withColumnRenamed("class", "class_t"), "e", "t")
    return (
        same.unionByName(nearly.select("e", "t", "eval_split", "source", F.lit("near_text").alias("kind"), "containment"))
        .where("e <> t").select(F.least("e", "t").alias("id_a"), F.greatest("e", "t").alias("id_b"), "eval_split", "source", "kind", "containment")
        .groupBy("id_a", "id_b").agg(F.min(F.struct("eval_split", "source")).alias("x"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("containment").alias("containment"))
        .select("id_a", "id_b", "x.eval_split", "x.source", "kinds", "containment")
    )


def leak_members(documents: DataFrame, observations: DataFrame) -> DataFrame:
    """``(document_id, class_id, n_content, n_near_duplicate, n_text)``: each document that takes part, with its class and links.

    ``class_id`` names the class of equal texts (null for a text without a
    letter); the counts are the documents on the other side that share the
    declared groups or the text. Copies are counted, not listed, so this stays
    as long as the table however large a group is. Documents without a TRAIN, DEV or TEST
    observation are left out; repeated documents count once.
    """
    members, _ = _members(documents, observations)
    members = cut(members.groupBy("doc", "class", "content", "near").agg(F.max("train").alias("train"), F.max("evaluation").alias("evaluation")), "members")
    out = members.select("doc", "class", "train", "evaluation", *(c for _, c in _KINDS[:2]))
    for kind, c in _KINDS:
        sides = members.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum(F.col("train").cast("long")).alias(f"{c}_t"), F.sum(F.col("evaluation").cast("long")).alias(f"{c}_e"))
        out = out.join(sides.withColumnRenamed(c, f"own_{c}"), F.col(c) == F.col(f"own_{c}"), "left").drop(f"own_{c}")

    def links(c: str) -> F.Column:
        """Those on the other side, without the document itself where it is on both."""
        twice = (F.col("train") & F.col("evaluation")).cast("long")
        one = F.col("evaluation").cast("long") * F.coalesce(F.col(f"{c}_t"), F.lit(0)) + F.col("train").cast("long") * F.coalesce(F.col(f"{c}_e"), F.lit(0))
        return F.when(twice == 0, one).when(F.col(f"{c}_t").isNull(), 0).otherwise(F.col(f"{c}_t") + F.col(f"{c}_e") - 2)

    return out.select(
        F.col("doc").alias("document_id"), F.col("class").alias("class_id"), links("content").alias("n_content"), links("near").alias("n_near_duplicate"), links("class").alias("n_text")
    )
