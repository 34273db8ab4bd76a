"""Channels over parsed tokens, and the syntactic graph.

Tables: ``sentences (doc_id, comp, sent, status)`` with status "ok", "pos_only" or
"failed" (``comp`` is the contiguous component), and ``tokens (doc_id, comp, sent,
id, form, upos, head, deprel)`` with dense ids from 1 and head 0 at the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .channel_sums import BEFORE, CLIPPED, FAILED, HISTORY, POS_ONLY, character_classes, measurer

# The classes, relations and cue forms that are counted.
POS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "NOUN", "NUM", "PART", "PRON", "PROPN", "SCONJ", "VERB")
OTHER_POS = ("INTJ", "PUNCT", "SYM", "X")
RELATIONS = (
    "acl", "advcl", "advmod", "amod", "appos", "aux", "case", "cc", "ccomp", "clf", "compound", "conj", "cop", "csubj", "det", "discourse", "dislocated", "flat",
    "iobj", "mark", "nmod", "nsubj", "nummod", "obj", "obl", "parataxis", "xcomp",
)
OTHER_RELATIONS = ("dep", "expl", "fixed", "goeswith", "list", "orphan", "punct", "reparandum", "root", "vocative")
CUES = {
    "pronoun_first": (("PRON",), ("我", "我们", "我們")),
    "pronoun_second": (("PRON",), ("你", "妳", "您", "你们", "你們", "妳們", "您们", "您們")),
    "pronoun_third": (("PRON",), ("他", "她", "它", "牠", "祂", "他们", "他們", "她们", "她們", "它们", "它們", "牠們", "祂們", "其")),
    "negator": (("ADV",), ("不", "未", "没", "沒", "别", "別", "无", "無")),
    "de_function_form": (("PART", "SCONJ"), ("的",)),
    "di_subordinator_form": (("SCONJ",), ("地",)),
    "de_extent_form": (("PART",), ("得",)),
    "le_auxiliary_form": (("AUX",), ("了",)),
    "zhe_auxiliary_form": (("AUX",), ("着", "著")),
    "guo_auxiliary_form": (("AUX",), ("过", "過")),
}
_FAMILIES = {"upos": POS, "deprel": RELATIONS, "cue": tuple(CUES)}
_SHAPES = ("word_length.mean", "word_length.ge4", "word.single_han", "word.latin", "word.decimal_digit")
_REUSE = ("lexical.mattr100", "lexical.entropy100", "upos.bigram_entropy100", "lexical.content_overlap", "lexical.trigram_reuse", "syntax.initial_pos_reuse")
_GEOMETRY = ("dependency.span_mean", "dependency.span_normalized", "dependency.depth_mean", "dependency.maxdepth_median")
_SYNTAX = ("syntax.predicate_heads", "syntax.subordinate_arcs", "syntax.predicate_conj_share", "syntax.nominal_modifier_size", "syntax.verb_root_without_subject", "syntax.preposed_modifiers")
CHANNELS = (*(f"upos.{p}" for p in POS), *(f"deprel.{r}" for r in RELATIONS), *_SHAPES, *(f"cue.{c}" for c in CUES), *_REUSE, *_GEOMETRY, *_SYNTAX)
#: Channels that need dependencies; those that look back at earlier sentences; all others need classes only.
DEPENDENT = (*(f"deprel.{r}" for r in RELATIONS), *_GEOMETRY, *_SYNTAX)
HISTORICAL = ("lexical.content_overlap", "lexical.trigram_reuse", "syntax.initial_pos_reuse")


def family(channel: str) -> str:
    """The family of a channel."""
    fixed = {"lexical.mattr100": "lexical_reuse", "lexical.entropy100": "lexical_reuse", "upos.bigram_entropy100": "upos_sequence"}
    start = {"upos": "upos_composition", "deprel": "dependency_composition", "word_length": "lexical_shape", "word": "lexical_shape", "lexical": "lexical_reuse", "dependency": "dependency_geometry", "syntax": "syntactic_configuration", "cue": "closed_class_cues"}
    return fixed.get(channel) or start[channel.split(".")[0]]


_DOCUMENT = ("doc_id",)


def _sums(tokens: DataFrame, names: tuple[str, ...], by: tuple[str, ...], together: bool, k: int = 100, stated: bool = False) -> DataFrame:
    """``(*by, n, d)``: arrays of the numerators and denominators of ``names``; null where a channel has no opportunity.

    All are counted in one pass over whole documents. With ``together`` the rows of a document already follow each other
    within one partition, and tokens are not shuffled; else they are shuffled once, by document. With ``stated`` the tokens carry
    the ``status`` of their sentence (and may carry ``clipped``), and ``flags`` has the states of the document or sentence.
    """
    flags = [_flags(tokens).alias("flags")] if stated else []
    tokens = tokens.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("comp", "sent", "id", "head")), "form", "upos", "deprel", *flags)
    if not together:
        tokens = tokens.repartition("doc_id").sortWithinPartitions("doc_id", "comp", "sent", "id")
    run = measurer(character_classes(tokens.sparkSession), names, by, k, (POS, RELATIONS, CUES))
    kind = {"doc_id": tokens.schema["doc_id"].dataType.simpleString(), "sent": "long"}
    return tokens.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in by) + ", n array<double>, d array<double>" + ", flags long" * stated)


def _flags(rows: DataFrame) -> Column:
    bit = lambda where, flag: F.when(where, flag).otherwise(0)
    clipped = F.col("clipped") if "clipped" in rows.columns else F.lit(False)
    return (bit(clipped, CLIPPED) + bit(F.col("status") == "failed", FAILED) + bit(F.col("status") == "pos_only", POS_ONLY)).cast("byte")


def _stated(sums: DataFrame) -> DataFrame:
    """The states in columns of their own; a null id joins no tokens."""
    flag = {"clipped": CLIPPED, "failed": FAILED, "pos_only": POS_ONLY, "history": HISTORY, "before": BEFORE}
    known = {c: F.when(F.col("doc_id").isNotNull(), F.col(c)) for c in ("n", "d")}
    return sums.withColumns(known | {c: F.col("flags").bitwiseAND(F.lit(x)).cast("boolean").cast("int") for c, x in flag.items()})


def measured(tokens: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = _DOCUMENT, together: bool = False, k: int = 100) -> DataFrame:
    """The channels of ``names``: ``(*by, channel, numerator, denominator)``; no row where the channel has no opportunity.

    Counts per sentence are over all sentences, also those of punctuation only. The denominator of a median is the number of its
    sentences, and its numerator the median times that. Only sentences of one component are compared; "earlier" means an earlier sentence of it.
    """
    rows = _sums(tokens, names, by, together, k).select(*by, "n", "d", F.posexplode(F.array(*map(F.lit, names))).alias("i", "channel"))
    return rows.select(*by, "channel", F.get("n", "i").alias("numerator"), F.get("d", "i").alias("denominator")).where("denominator is not null")


#: What words are (classes, relations, shapes, cues); how they hang together; what neighbours and earlier sentences share; windows.
SHARES = tuple(c for c in CHANNELS if c.startswith(("deprel.", "word", "cue.")) or c.startswith("upos.") and c not in _REUSE)
DEPENDENCIES = (*_GEOMETRY, *_SYNTAX)
REUSES = ("lexical.trigram_reuse", "syntax.initial_pos_reuse", "lexical.content_overlap")
WINDOWED = ("lexical.mattr100", "lexical.entropy100", "upos.bigram_entropy100")


def channels(sentences: DataFrame | None, tokens: DataFrame, names: tuple[str, ...] = CHANNELS, together: bool = False) -> DataFrame:
    """``(doc_id, channel, value, numerator, denominator, missing)``: the channels of every document (see :func:`measured`).

    A sentence that the targets clip nulls all values of its document ("ineligible_structure"; ``sentences`` may have a
    boolean ``clipped``), a failed one too; one with classes only nulls the dependency channels; without opportunity a value is null, never zero.
    Without ``sentences`` the tokens carry the ``status`` of their sentence, and maybe ``clipped``, every sentence has tokens, and nothing is joined.
    """
    if sentences is None:
        return _valued(_gridded(_stated(_sums(tokens, names, _DOCUMENT, together, stated=True)), names), _DOCUMENT)
    clipped = F.coalesce("clipped", F.lit(False)) if "clipped" in sentences.columns else F.lit(False)
    state = sentences.groupBy("doc_id").agg(F.max(clipped.cast("int")).alias("clipped"), F.max((F.col("status") == "failed").cast("int")).alias("failed"), F.max((F.col("status") == "pos_only").cast("int")).alias("pos_only"))
    return _valued(_gridded(state.join(_sums(tokens, names, _DOCUMENT, together), list(_DOCUMENT), "left"), names), _DOCUMENT)


def _gridded(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """A row for each row and channel. Arrays are joined with the states before, not their entries, so that a document or sentence is one row of the join."""
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, names))).alias("i", "channel"))
    return rows.withColumns({"numerator": F.get("n", "i"), "denominator": F.get("d", "i")})


def _valued(rows: DataFrame, by: tuple[str, ...], history: Column | None = None) -> DataFrame:
    history = F.lit(0) if history is None else history
    missing = (
        F.when(F.col("clipped") == 1, "ineligible_structure").when(F.col("failed") == 1, "parse_failed").when((F.col("pos_only") == 1) & F.col("channel").isin(*DEPENDENT) & (F.col("channel") != "syntax.initial_pos_reuse"), "pos_only")
        .when((history == 1) & F.col("channel").isin(*HISTORICAL), "history_failed").when(F.coalesce("denominator", F.lit(0.0)) == 0, "zero_denominator")
    )
    value = F.when(missing.isNull(), F.try_divide("numerator", "denominator"))
    return rows.select(*by, "channel", F.round(value, 9).alias("value"), "numerator", "denominator", missing.alias("missing"))


def sequences(sentences: DataFrame | None, tokens: DataFrame, names: tuple[str, ...] = CHANNELS, together: bool = False) -> DataFrame:
    """``(doc_id, sent, channel, value, numerator, denominator, missing)``: the channels of every sentence by itself.

    Reuse looks back at earlier sentences of the component; where one of those failed (for the overlap, the one before), it is "history_failed".
    A failed sentence nulls its own values only. Without ``sentences`` the tokens carry the ``status`` of their sentence, every sentence
    has tokens, and nothing is joined.
    """
    by = ("doc_id", "sent")
    history = F.when(F.col("channel") == "lexical.content_overlap", F.col("before")).otherwise(F.col("history"))
    if sentences is None:
        rows = _stated(_sums(tokens, names, by, together, stated=True)).withColumn("clipped", F.lit(0))
        return _valued(_gridded(rows, names), by, history)
    earlier = Window.partitionBy("doc_id", "comp").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    failed = (F.col("status") == "failed").cast("int")
    last = Window.partitionBy("doc_id", "comp").orderBy("sent")
    before = F.when(F.lag("sent").over(last) == F.col("sent") - 1, F.lag(failed).over(last))
    state = sentences.select(*by, F.lit(0).alias("clipped"), failed.alias("failed"), (F.col("status") == "pos_only").cast("int").alias("pos_only"), F.coalesce(F.max(failed).over(earlier), F.lit(0)).alias("history"), F.coalesce(before, F.lit(0)).alias("before"))
    return _valued(_gridded(state.join(_sums(tokens, names, by, together), list(by), "left"), names), by, history)


def vectors(rows: DataFrame) -> DataFrame:
    """``(doc_id, value, opportunity, reason)``: the channels as parallel arrays in their fixed order."""
    place = F.create_map(*(x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(i))))
    ordered = F.sort_array(F.collect_list(F.struct(place[F.col("channel")].alias("i"), "value", "denominator", "missing")))
    return rows.groupBy("doc_id").agg(ordered.alias("x")).select("doc_id", F.col("x.value").alias("value"), F.col("x.denominator").alias("opportunity"), F.col("x.missing").alias("reason"))


def edges(tokens: DataFrame) -> DataFrame:
    """``(doc_id, src, dst, kind)`` of the syntactic graph: sentence to token, head to token, sentence to next."""
    s, t = F.concat(F.lit("s"), "sent"), F.concat(F.lit("t"), "sent", F.lit("."), "id")
    contains = tokens.select("doc_id", s.alias("src"), t.alias("dst"), F.lit("contains_token").alias("kind"))
    ud = tokens.where("head > 0").select("doc_id", F.concat(F.lit("t"), "sent", F.lit("."), "head").alias("src"), t.alias("dst"), F.concat(F.lit("ud:"), "deprel").alias("kind"))
    sents = tokens.select("doc_id", "sent").distinct()
    after = sents.withColumn("next", F.lead("sent").over(Window.partitionBy("doc_id").orderBy("sent"))).where("next = sent + 1")
    return contains.unionByName(ud).unionByName(after.select("doc_id", s.alias("src"), F.concat(F.lit("s"), "next").alias("dst"), F.lit("original_next_sentence").alias("kind")))


def _rings(tokens: DataFrame) -> DataFrame:
    """``(doc_id, sent)`` of sentences where some token's heads never reach the root."""
    rows = tokens.where("head is not null").groupBy("doc_id", "sent").agg(F.map_from_entries(F.collect_list(F.struct("id", "head"))).alias("up"), F.count("*").alias("n"))
    # All tokens climb at once; doubling the step each time, as many rounds as the sentence has bits suffice.
    step = lambda up: F.transform_values(up, lambda _, h: F.coalesce(F.try_element_at(up, h), F.lit(0).cast("long")))
    rows = rows.withColumn("up", F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.col("up"), lambda up, _: step(up)))
    return rows.where(F.exists(F.map_values("up"), lambda h: h != 0)).select("doc_id", "sent", F.lit(True).alias("ring"))


def parse_problems(sentences: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(doc_id, sent, problem)``: the first rule that a parse breaks.

    Tokens of a sentence that is not failed must be there, numbered from 1, of known classes and, if status is "ok", one tree of known relations
    whose root alone is "root", without a ring; a failed sentence has no tokens, one with classes only ("pos_only") no heads or relations. Sentences have at most 2048 tokens.
    """
    relation = F.element_at(F.split("deprel", ":"), 1)
    sure = lambda x: F.coalesce(x, F.lit(False))
    unique = tokens.dropDuplicates(["doc_id", "sent", "id"])
    ids = tokens.groupBy("doc_id", "sent").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum((F.col("head") == 0).cast("long")).alias("roots"),
        F.max((F.col("head").isNull() | (F.col("head") < 0) | (F.col("head") == F.col("id"))).cast("int")).alias("bad_head"), F.max("head").alias("top"),
        F.max((~sure(F.col("upos").isin(*POS, *OTHER_POS))).cast("int")).alias("bad_pos"), F.max((~sure(relation.isin(*RELATIONS, *OTHER_RELATIONS) & F.col("deprel").rlike("^[a-z]+(:[a-z]+)?$"))).cast("int")).alias("bad_rel"),
        F.max((sure(F.col("head") == 0) != sure(F.col("deprel") == "root")).cast("int")).alias("root_rel"), F.max((F.col("head").isNotNull() | F.col("deprel").isNotNull()).cast("int")).alias("any_head"),
    )
    rows = sentences.join(ids, ["doc_id", "sent"], "left").join(_rings(unique), ["doc_id", "sent"], "left")
    ok, there = F.col("status") == "ok", F.col("n").isNotNull()
    problem = (
        F.when(~sure(F.col("status").isin("ok", "pos_only", "failed")), "status").when((F.col("status") == "failed") & there, "failed_with_tokens").when((F.col("status") != "failed") & ~there, "missing_parse").when(F.col("n") > 2048, "too_many_tokens")
        .when((F.col("low") != 1) | (F.col("high") != F.col("n")) | (F.col("d") != F.col("n")), "ids").when(F.col("bad_pos") == 1, "upos").when((F.col("status") == "pos_only") & (F.col("any_head") == 1), "pos_only_with_heads")
        .when(ok & (F.col("roots") != 1), "roots").when(ok & ((F.col("bad_head") == 1) | (F.col("top") > F.col("n"))), "head").when(ok & (F.col("bad_rel") == 1), "deprel").when(ok & (F.col("root_rel") == 1), "root_relation").when(ok & F.col("ring"), "cycle")
    )
    return rows.select("doc_id", "sent", problem.alias("problem")).where("problem is not null")


def inventory(tokens: DataFrame) -> DataFrame:
    """``(kind, name, n)``: how often each class and each base relation stands."""
    upos = tokens.groupBy(F.col("upos").alias("name")).agg(F.count("*").alias("n")).select(F.lit("upos").alias("kind"), "name", "n")
    rel = tokens.where("deprel is not null").groupBy(F.element_at(F.split("deprel", ":"), 1).alias("name")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("kind"), "name", "n")
    return upos.unionByName(rel)


def catalog(spark) -> DataFrame:
    """``(family, n)``: the channels by family."""
    counts: dict[str, int] = {}
    for c in CHANNELS:
        counts[family(c)] = counts.get(family(c), 0) + 1
    return spark.createDataFrame(sorted(counts.items()), "family string, n long")


def parse_coverage(parses: DataFrame) -> DataFrame:
    """``(document_id, n_parses, n_sentences, n_repeated, n_missing, n_ok, n_pos_only, n_failed, n_clipped, complete)`` of stored parses.

    Indices run from 0; a row again with the same index and span is a repeat, and
    an index never seen below the greatest one is missing. A document is complete when nothing is missing,
    failed or clipped. Null ids and null indices are left out.
    """
    rows = parses.where("document_id is not null and source_sentence_index is not null")
    once = rows.groupBy("document_id", "source_sentence_index").agg(
        F.count("*").alias("n"), F.max((F.col("status") == "ok").cast("int")).alias("ok"), F.max((F.col("status") == "pos_only").cast("int")).alias("pos_only"),
        F.max((F.col("status") == "failed").cast("int")).alias("failed"), F.max((F.col("analysis_status") == "clipped").cast("int")).alias("clipped"),
    )
    per = once.groupBy("document_id").agg(
        F.sum("n").alias("n_parses"), F.count("*").alias("n_sentences"), (F.sum("n") - F.count("*")).alias("n_repeated"), (F.max("source_sentence_index") + 1 - F.count("*")).alias("n_missing"),
        F.sum("ok").alias("n_ok"), F.sum("pos_only").alias("n_pos_only"), F.sum("failed").alias("n_failed"), F.sum("clipped").alias("n_clipped"),
    )
    return per.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_failed") == 0) & (F.col("n_clipped") == 0))
