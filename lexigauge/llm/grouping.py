"""Problem 5: splits that keep related records together.

Minimum labels travel over the bipartite graph of record sets and declared
entities until nothing changes; whole linked sets are then assigned to splits so
that the shares hold in every stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, known_id
from ..sources.tables import cut, drop_cut

#: Sets that hold at least one of this many parts of all rows are placed one by one; there are at most as many.
LARGE_PARTS = 256
#: Hash slots of the smaller sets in each stratum: the grain of the shares.
SLOTS = 4096
#: Parts of a set that holds one of ``LARGE_PARTS`` parts of all rows, when rows look up their set.
SALTS = 64
#: Rounds at most in which the splits' factors are fitted to the shares of the whole.
ROUNDS = 20


def _set_key(component: Column, row_id: Column) -> Column:
    """The record set of a row: its component, or the row alone where that is not known."""
    known = known_id(component)
    return F.when(known.isNotNull(), F.concat(F.lit("c:"), known)).otherwise(F.concat(F.lit("i:"), F.coalesce(folded(row_id), F.lit(""))))


def linked_sets(links: DataFrame) -> DataFrame:
    """``(member, root)``: the least member reachable from each member over shared entities.

    ``links`` has string columns ``member`` and ``entity``; rows with a null in
    either link nothing, repeated rows count once. A round sends each member's
    label to its entities and the least one back, then replaces every label by
    its own label's label, so that long chains shorten by half each round. No
    rows: an empty result.
    """
    edges = cut(links.where("member is not null and entity is not null").select("member", "entity").distinct(), "links")
    labels = cut(edges.groupBy("entity").agg(F.min("member").alias("root")).join(edges, "entity").groupBy("member").agg(F.min("root").alias("root")), "labels")
    while True:
        low = edges.join(labels, "member").groupBy("entity").agg(F.min("root").alias("low"))
        step = edges.join(low, "entity").groupBy("member").agg(F.min("low").alias("low"))
        onward = labels.select(F.col("member").alias("low"), F.col("root").alias("next"))
        new = step.join(onward, "low").select("member", F.least("low", "next").alias("root"))
        new = cut(new, "labels")
        changed = new.join(labels.withColumnRenamed("root", "old"), "member").where("root <> old").limit(1).count()
        drop_cut(labels)
        labels = new
        if not changed:
            drop_cut(edges)
            return labels


def observation_sets(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """``(set, root)`` of the record sets that share a work or lineage with another; the rest are their own root.

    Observations are tied by ``component_id``, or by ``leakage.work_id`` or
    ``leakage.lineage_id`` of the document of the same id, compared without case
    and outer white space; ids that are null or stand in for "not known" tie
    nothing. Documents without observation tie nothing.
    """
    declared = documents.select(
        folded(F.col("document_id")).alias("key"),
        F.explode(F.array(F.concat(F.lit("w:"), known_id(F.col("leakage.work_id"))), F.concat(F.lit("l:"), known_id(F.col("leakage.lineage_id"))))).alias("entity"),
    ).where("entity is not null and key is not null")
    rows = observations.select(folded(F.col("id")).alias("key"), _set_key(F.col("component_id"), F.col("id")).alias("member")).where("key is not null").distinct()
    # An id that stands in several record sets links them.
    several = rows.groupBy("key").agg(F.min("member").alias("low"), F.max("member").alias("high")).where("low <> high").select("key")
    twice = rows.join(several, "key").select("member", F.concat(F.lit("i:"), F.col("key")).alias("entity"))
    return linked_sets(rows.join(declared, "key").select("member", "entity").unionByName(twice)).withColumnRenamed("member", "set")


def _looked_up(rows: DataFrame, wanted: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with what ``wanted`` says of their ``set`` (once each), the rows of ``hot`` sets in ``SALTS`` parts."""
    hot = F.broadcast(hot.select("set", F.lit(SALTS).alias("parts")))
    parts = F.coalesce(F.col("parts"), F.lit(1))
    left = rows.join(hot, "set", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    right = wanted.join(hot, "set", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["set", "part"]).drop("part")


def _rooted(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, split, source, condition, set, root)`` of every observation row."""
    sets = observation_sets(observations, documents)
    rows = observations.select(
        "id", F.upper(folded(F.col("split"))).alias("split"), folded(F.col("source")).alias("source"), "condition", _set_key(F.col("component_id"), F.col("id")).alias("set")
    )
    return rows, sets


def broken_ties(observations: DataFrame, documents: DataFrame) -> DataFrame:
    """``(id, root)``: every observation id in a linked set that holds more than one split, once.

    Splits are compared without case and outer spaces; null (or blank) is no
    split, but ids without split are listed when their set is. Null ids are not
    listed. Splits are gathered per set first, so a set of any size is never in one task.
    """
    rows, sets = _rooted(observations, documents)
    known = F.when(F.col("split") != "", F.col("split"))
    own = rows.groupBy("set").agg(F.min(known).alias("low"), F.max(known).alias("high"), F.count("*").alias("n"))
    own = cut(own.join(sets, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "low", "high", "n"), "sets")
    total = own.agg(F.sum("n")).first()[0] or 0
    hot = own.where(F.col("n") * LARGE_PARTS >= F.lit(max(total, 1)))
    mixed = own.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("root")
    wanted = own.join(mixed, "root").select("set", "root")
    return _looked_up(rows.where("id is not null").select("id", "set"), wanted, hot).select("id", "root").distinct()


def assign_splits(observations: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(id, root, split)``: a split for every observation id, the same for all of a linked set.

    Shares come from ``targets`` (``split``, ``share``; at most 100 rows, shares are
    scaled to sum 1). The stratum of a set is its most frequent pair of source and condition.
    Sets with at least 1 / ``LARGE_PARTS`` of all rows are placed one by one,
    largest first, where they fit and the deficit in the strata of their rows is
    greatest; the others fall into hash slots of their stratum, and the slots are
    dealt so that each stratum's shares, with the large sets' rows in it counted in,
    come out as given. Where large sets alone exceed a share of a stratum, the
    others make up for it, so that the shares of the whole hold. Null ids are left out.
    """
    shares = [(r.split, float(r.share)) for r in targets.where("split is not null and share > 0").orderBy("split").limit(101).collect()]
    if not shares or len(shares) > 100:
        raise ValueError("targets must have from 1 to 100 rows with a positive share")
    scale = sum(s for _, s in shares)
    shares = [(name, s / scale) for name, s in shares]
    rows, sets = _rooted(observations, documents)
    rows = rows.where("id is not null").select("id", "set", F.concat_ws("/", F.coalesce("source", F.lit("?")), F.coalesce("condition", F.lit("?"))).alias("label"))
    # Rows of one id may bear other labels: the least counts.
    rows = cut(rows.groupBy("id", "set").agg(F.min("label").alias("label")), "rows")
    per_set = rows.groupBy("set", "label").count()
    counts = per_set.join(sets, "set", "left").groupBy(F.coalesce("root", "set").alias("root"), "label").agg(F.sum("count").alias("n"))
    per_root = counts.groupBy("root").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).getField("label").alias("stratum"))
    per_root = cut(per_root.withColumn("slot", F.pmod(F.xxhash64("root"), F.lit(SLOTS)).cast("int")), "groups")
    total = per_root.agg(F.sum("n")).first()[0] or 0

    large = per_root.where(F.col("n") * LARGE_PARTS >= F.lit(max(total, 1))).orderBy(F.desc("n"), "root").collect()
    spark = observations.sparkSession
    counts = cut(counts, "counts")
    held: dict[str, dict[str, int]] = {}
    for r in counts.join(F.broadcast(spark.createDataFrame([(r.root,) for r in large], "root string")), "root").collect():
        held.setdefault(r.root, {})[r.label] = r.n
    labels = spark.createDataFrame([(x,) for x in sorted({x for own in held.values() for x in own})], "label string")
    all_of = {r.label: r.n for r in counts.join(F.broadcast(labels), "label").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    placed: dict[str, int] = dict.fromkeys((name for name, _ in shares), 0)
    by_label: dict[tuple[str, str], int] = {}
    chosen = []
    for r in large:
        own = held[r.root]

        def wish(s: tuple[str, float]) -> tuple[bool, float]:
            whole = s[1] * total - placed[s[0]]
            if whole < r.n:
                return False, whole
            return True, sum(n * (s[1] * all_of[x] - by_label.get((x, s[0]), 0)) for x, n in own.items()) / r.n

        name = max(shares, key=wish)[0]
        placed[name] += r.n
        for x, n in own.items():
            by_label[x, name] = by_label.get((x, name), 0) + n
        chosen.append((r.root, name))
    chosen_df = spark.createDataFrame(chosen, "root string, split string")

    small = per_root.join(F.broadcast(chosen_df.select("root")), "root", "left_anti")
    slots = small.groupBy("stratum", "slot").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("stratum").orderBy("slot")
    sums = slots.select("stratum", "slot", (F.sum("n").over(ordered) - F.col("n") / 2).alias("middle"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    # What each split still lacks in each stratum after the large sets' rows there; its factor makes up in the other strata for what one has too much of.
    taken = spark.createDataFrame([(x, [by_label.get((x, name), 0) for name, _ in shares]) for x in all_of], "stratum string, taken array<long>")
    strata = counts.groupBy(F.col("label").alias("stratum")).agg(F.sum("n").alias("rows")).join(F.broadcast(taken), "stratum", "left")
    lacks = [F.greatest(F.lit(0.0), F.lit(share) * F.col("rows") - F.coalesce(F.col("taken")[k], F.lit(0))) for k, (_, share) in enumerate(shares)]
    strata = cut(small.groupBy("stratum").agg(F.sum("n").alias("small")).join(strata.select("stratum", F.array(*lacks).alias("lack")), "stratum"), "strata")

    def weights(factors: list[float]) -> list[Column]:
        return [F.col("lack")[k] * F.lit(f) for k, f in enumerate(factors)]

    lack = [max(0.0, share * total - placed[name]) for name, share in shares]
    rest = (total - sum(r.n for r in large)) / (sum(lack) or 1.0)
    factors = [1.0] * len(shares)
    for _ in range(ROUNDS):
        own = weights(factors)
        got = strata.agg(*(F.sum(F.col("small") * w / sum(own, F.lit(0.0))).alias(f"w{k}") for k, w in enumerate(own))).first()
        got = [x or 0.0 for x in got]
        if all(abs(x - y * rest) <= total / SLOTS for x, y in zip(got, lack)):
            break
        factors = [min(1e9, max(1e-9, f * y * rest / x)) if x else f for f, x, y in zip(factors, got, lack)]
    own = weights(factors)
    edged = strata.select("stratum", F.array(*(sum(own[: k + 1], F.lit(0.0)) / sum(own, F.lit(0.0)) for k in range(len(own)))).alias("edges"))
    sums = sums.join(edged, "stratum")
    split = F.lit(shares[-1][0])
    for k, (name, _) in reversed(list(enumerate(shares[:-1]))):
        split = F.when(F.col("middle") <= F.col("all") * F.col("edges")[k], F.lit(name)).otherwise(split)
    dealt = small.join(sums.select("stratum", "slot", split.alias("split")), ["stratum", "slot"]).select("root", "split")
    by_root = dealt.unionByName(chosen_df)
    # Sets, not rows, look up their root's split; then rows their set.
    by_set = per_set.select("set").distinct().join(sets, "set", "left").select("set", F.coalesce("root", "set").alias("root")).join(by_root, "root")
    hot = per_set.groupBy("set").agg(F.sum("count").alias("n")).where(F.col("n") * LARGE_PARTS >= F.lit(max(total, 1)))
    return _looked_up(rows.select("id", "set"), by_set, hot).select("id", "root", "split").distinct()


def deviations(observations: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """``(stratum, split, n, share, target, deviation)``: what each stratum's splits hold and how far that is from the target.

    A stratum is a pair of source and condition; every id counts once, with its
    least stratum. Splits that got nothing in a stratum have n = 0.
    """
    label = F.concat_ws("/", F.coalesce(folded(F.col("source")), F.lit("?")), F.coalesce("condition", F.lit("?")))
    labels = observations.where("id is not null").groupBy("id").agg(F.min(label).alias("stratum"))
    got = assign_splits(observations, documents, targets).select("id", "split").join(labels, "id").groupBy("stratum", "split").agg(F.count("*").alias("n"))
    got = cut(got, "shares")
    scale = targets.where("split is not null and share > 0").agg(F.sum("share")).first()[0]
    wanted = F.broadcast(targets.where("split is not null and share > 0").select("split", (F.col("share") / F.lit(scale)).alias("target")))
    sizes = got.groupBy("stratum").agg(F.sum("n").alias("all"))
    grid = sizes.select("stratum", "all", F.explode(F.array(*(F.lit(r.split) for r in targets.where("split is not null and share > 0").select("split").collect()))).alias("split"))
    full = grid.join(wanted, "split").join(got, ["stratum", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    share = F.col("n") / F.col("all")
    return full.select("stratum", "split", "n", F.round(share, 9).alias("share"), "target", F.round(share - F.col("target"), 9).alias("deviation"))
