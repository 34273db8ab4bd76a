"""Numerators and denominators of the token channels, all of them in one pass over whole documents.

Tokens come as Arrow batches in which the rows of a document follow each other; numpy counts over the tokens of many documents at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

#: Tokens that are measured together at least, whole documents each.
CHUNK = 200_000
#: Bits of a character's class.
BLANK, HAN, LATIN, DIGIT = 1, 2, 4, 8
_PATTERNS = {BLANK: r"[\p{P}\s]", HAN: r"\p{IsHan}", LATIN: r"[\p{IsLatin}&&\p{L}]", DIGIT: r"\p{Nd}"}
#: Bits of the state of a document or sentence.
CLIPPED, FAILED, POS_ONLY, HISTORY, BEFORE = 1, 2, 4, 8, 16
_known: list[tuple[np.ndarray, np.ndarray]] = []


def character_classes(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """Starts and bits of the runs of code points of one class, by the JVM's patterns."""
    if not _known:
        text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        bits = np.zeros(0x110000, np.uint8)
        for bit, pattern in _PATTERNS.items():
            other = spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher(text).replaceAll("")
            inside = np.ones(0x110000, bool)
            inside[np.frombuffer(other.encode("utf-32-le"), np.uint32)] = False
            inside[0xD800:0xE000] = False
            bits[inside] |= bit
        starts = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
        _known.append((starts, bits[starts]))
    return _known[0]


def _tree(rows: list[tuple[int, int | None, str | None, bool]]) -> dict[int, tuple[int, int]]:
    """Depth and modifier subtree of every id of one sentence (id, head, relation, lexical), also where ids repeat or heads run in a ring."""
    head, relation = {i: h for i, h, _, _ in rows}, {i: r or "" for i, _, r, _ in rows}
    depth: dict[int, int] = {}
    for start in head:
        path, at = [], start
        while at in head and at not in depth and head[at] and at not in path:
            path.append(at)
            at = head[at]
        base = depth.get(at, 0)
        for k, x in enumerate(reversed(path), 1):
            depth[x] = base + k
    below: dict[int, set[int]] = {x: set() for x in head}
    for x in {i for i, _, _, lex in rows if lex}:
        at, seen = x, set()
        while at in head and head[at] and at not in seen:
            seen.add(at)
            if relation[at] in ("acl", "nmod") and head[at] in below:
                below[head[at]].add(x)
            at = head[at]
    return {x: (depth.get(x, 0), len(below[x])) for x in head}


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any of the keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by the last key, then those before it; rows mostly come in order already."""
    rises = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        rises = (k[1:] > k[:-1]) | ((k[1:] == k[:-1]) & rises)
    equal = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return np.arange(len(keys[0])) if (rises | equal).all() else np.lexsort(keys)


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Codes of the values, -1 for null, and the values."""
    made = column.dictionary_encode()
    return made.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary.to_pylist()


def _of(values: list, names: tuple[str, ...]) -> np.ndarray:
    """The place of each value in ``names``, or their number; the last entry stands for null."""
    place = {x: i for i, x in enumerate(names)}
    return np.array([*(place.get(x, len(names)) for x in values), len(names)])


class Chunk:
    """The tokens of some whole documents, in order, with what several channels need."""

    def __init__(self, rows: pa.Table, classes: np.ndarray, by_sentence: bool):
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        column = {c: x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for c, x in column.items()}
        number = lambda c: column[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        doc_code, _ = _codes(column["doc_id"])
        doc = np.cumsum(_starts(doc_code)) - 1
        keys = [number("id"), number("sent"), number("comp"), doc]
        order = _order(keys)
        self.id, self.sent, self.comp, self.doc = (k[order] for k in keys)
        self.known = doc_code[order] >= 0
        self.head = number("head")[order]
        self.headed = column["head"].is_valid().to_numpy(zero_copy_only=False)[order]
        form, self.forms = _codes(column["form"])
        upos, self.tags = _codes(column["upos"])
        deprel, relations = _codes(column["deprel"])
        bases = [x.split(":")[0] for x in relations]
        self.relations = list(dict.fromkeys(bases))
        place = {x: i for i, x in enumerate(self.relations)}
        self.form, self.upos, self.rel = form[order], upos[order], np.array([*(place[x] for x in bases), -1])[deprel[order]]
        self._shapes(classes)
        new = _starts(self.doc, self.comp, self.sent)
        self.seg, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.part = np.cumsum(_starts(self.doc, self.comp)) - 1
        self.lexical = np.flatnonzero((self.upos >= 0) & (_of(self.tags, ("PUNCT",))[self.upos] == 1) & ~self.blank[self.form])
        self.flags = number("flags")[order] if "flags" in column else None
        # Groups: documents or sentences.
        self.group = self.seg if by_sentence else self.doc
        self.groups = int(self.group[-1]) + 1
        self.leaders = order[np.flatnonzero(_starts(self.group))]
        self.by_sentence = by_sentence
        self._words()

    def _shapes(self, classes: np.ndarray) -> None:
        """What a form is made of; the last entry stands for null, which is no word."""
        forms = self.forms
        size = np.array([len(x) for x in forms], np.int64)
        bits = classes[np.frombuffer("".join(forms).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(forms)), size)
        count = lambda bit: np.append(np.bincount(owner[bits & bit > 0], minlength=len(forms)), 0)
        size = np.append(size, 0)
        self.bare = size - count(BLANK)
        self.blank = self.bare == 0
        self.han, self.latin, self.digit = (size == 1) & (count(HAN) == 1), count(LATIN) > 0, count(DIGIT) > 0

    def _words(self) -> None:
        """Ranks of the words, and a row for each word and lexical head of it (in a sound parse, for each word)."""
        words = self.lexical
        seg = self.seg[words]
        self.size = np.bincount(seg, minlength=len(self.first))
        rank = np.arange(len(words)) - (np.cumsum(self.size) - self.size)[seg]
        low = min(self.id.min(), 0)
        ids, heads = self.id - low, self.head - low
        if (wide := int(ids.max()) + 1) > 1_000_000:
            values = np.unique(ids)
            wide, at = len(values), np.searchsorted(values, heads)
            ids, heads = np.searchsorted(values, ids), np.where(values[np.minimum(at, wide - 1)] == heads, at, -1)
        self.key = self.seg * wide + ids
        self.up = np.where(self.headed & self.known & (heads >= 0) & (heads < wide), self.seg * wide + heads, -1)
        keys, up = self.key[words], self.up[words]
        at, row = self._find(keys, up), np.arange(len(words))
        if (keys[1:] == keys[:-1]).any():
            n = np.where(at >= 0, np.searchsorted(keys, up, "right") - at, 1)
            row = np.repeat(row, n)
            at = np.where(at[row] >= 0, at[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), -1)
        self.row, self.rank, self.head_rank = words[row], rank[row], np.where(at >= 0, rank[at], -1) if len(rank) else rank
        self.own = self.group[self.row]
        rel = self.rel[self.row]
        self.arc = (at >= 0) & (rel >= 0) & (_of(self.relations, ("punct",))[rel] == 1)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where each wanted key stands first in the ordered keys, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.searchsorted(keys, wanted)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, -1)

    def states(self) -> np.ndarray:
        """The flags of each group; of a sentence also whether an earlier one of its component failed, and whether the one just before did."""
        own = np.bitwise_or.reduceat(self.flags, np.flatnonzero(_starts(self.group)))
        if not self.by_sentence:
            return own
        part, sent, failed = self.part[self.first], self.sent[self.first], own & FAILED > 0
        earlier = np.cumsum(failed) - failed
        history = earlier > earlier[np.flatnonzero(_starts(part))][part]
        before = np.zeros(len(own), bool)
        before[1:] = failed[:-1] & (part[1:] == part[:-1]) & (sent[1:] == sent[:-1] + 1)
        return own | HISTORY * history | BEFORE * before

    def n(self, where: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Rows, or the sum of their weights, by group."""
        return np.bincount(self.own[where], None if weights is None else weights[where], self.groups).astype(float)

    def is_rel(self, *names: str) -> np.ndarray:
        return (_of(self.relations, names) < len(names))[self.rel[self.row]]

    def is_tag(self, *names: str) -> np.ndarray:
        return (_of(self.tags, names) < len(names))[self.upos[self.row]]

    def shares(self, pos: tuple[str, ...], relations: tuple[str, ...], cues: dict) -> dict:
        def table(kind: np.ndarray, names: tuple[str, ...], where: np.ndarray | slice = slice(None)) -> np.ndarray:
            return np.bincount(self.own[where] * (len(names) + 1) + kind[where], minlength=self.groups * (len(names) + 1)).reshape(self.groups, -1).astype(float)

        every = np.ones(len(self.row), bool)
        all_words, arcs = self.n(every), self.n(self.arc)
        form, upos = self.form[self.row], self.upos[self.row]
        tags, rels = table(_of(self.tags, pos)[upos], pos), table(_of(self.relations, relations)[self.rel[self.row]], relations, self.arc)
        out = {f"upos.{p}": (tags[:, i], all_words) for i, p in enumerate(pos)} | {f"deprel.{r}": (rels[:, i], arcs) for i, r in enumerate(relations)}
        bare = self.bare[form]
        out["word_length.mean"] = (self.n(every, bare), all_words)
        for name, where in (("word_length.ge4", bare >= 4), ("word.single_han", self.han[form]), ("word.latin", self.latin[form]), ("word.decimal_digit", self.digit[form])):
            out[name] = (self.n(where), all_words)
        for name, (allowed, forms) in cues.items():
            hit = (_of(self.forms, forms) < len(forms))[form]
            out[f"cue.{name}"] = (self.n(hit & self.is_tag(*allowed)) if hit.any() else np.zeros(self.groups), all_words)
        there = all_words > 0
        return {k: (np.where(there, a, np.nan), np.where(there, b, np.nan)) for k, (a, b) in out.items()}

    def _geometry(self) -> tuple[np.ndarray, np.ndarray]:
        """Depth of every token and words under its acl and nmod children."""
        n = len(self.id)
        parent, alive = self._find(self.key, self.up), self.headed & (self.head != 0)
        modifier = (_of(self.relations, ("acl", "nmod")) < 2)[self.rel]
        word = np.zeros(n, bool)
        word[self.lexical] = True
        depth, below = np.zeros(n, np.int64), np.zeros(n, np.int64)
        start = np.flatnonzero(alive)
        at, longest = start, int(np.diff(np.append(self.first, n)).max())
        for _ in range(longest):
            if not len(start):
                break
            depth[start] += 1
            to = parent[at]
            counted = word[start] & modifier[at] & (to >= 0)
            below += np.bincount(to[counted], minlength=n)
            kept = to >= 0
            kept[kept] = alive[to[kept]]
            start, at = start[kept], to[kept]
        again = np.concatenate((self.seg[start], self.seg[1:][self.key[1:] == self.key[:-1]]))
        for s in np.unique(again):
            a = self.first[s]
            b = self.first[s + 1] if s + 1 < len(self.first) else n
            rows = [(int(self.id[i]), int(self.head[i]) if self.headed[i] else None, self.relations[self.rel[i]] if self.rel[i] >= 0 else None, bool(word[i])) for i in range(a, b)]
            made = _tree(rows)
            depth[a:b], below[a:b] = zip(*(made[r[0]] for r in rows))
        return depth, below

    def dependencies(self) -> dict:
        depth, below = self._geometry()
        row, arc, every = self.row, self.arc, self.known[self.row]
        span = np.abs(self.rank - self.head_rank)
        root = self.headed[row] & (self.head[row] == 0) & every
        predicate = self.is_tag("VERB", "ADJ", "AUX") & (root | self.is_rel("ccomp", "xcomp", "advcl", "acl", "conj", "parataxis")) & every
        noun, modifier, verb_root = self.is_tag("NOUN", "PROPN") & every, arc & self.is_rel("amod", "nmod", "acl", "advmod"), root & self.is_tag("VERB")
        subject = np.unique(self.up[(_of(self.relations, ("nsubj", "csubj")) < 2)[self.rel]])
        bare = verb_root.copy()
        bare[verb_root] = self._find(subject, self.key[row[verb_root]]) < 0
        sents = np.bincount(self.group[self.first], minlength=self.groups).astype(float)
        out = {
            "dependency.span_mean": (self.n(arc, span), self.n(arc)), "dependency.span_normalized": (self.n(arc, span / np.maximum(self.size[self.seg[row]] - 1, 1)), self.n(arc)),
            "dependency.depth_mean": (self.n(every, depth[row]), self.n(every)), "syntax.predicate_heads": (self.n(predicate), sents),
            "syntax.subordinate_arcs": (100 * self.n(arc & self.is_rel("ccomp", "xcomp", "advcl", "acl")), sents), "syntax.predicate_conj_share": (self.n(predicate & self.is_rel("conj")), self.n(predicate)),
            "syntax.nominal_modifier_size": (self.n(noun, below[row]), self.n(noun)), "syntax.verb_root_without_subject": (self.n(bare), self.n(verb_root)),
            "syntax.preposed_modifiers": (self.n(modifier & (self.rank < self.head_rank)), self.n(modifier)),
        }
        # The median over sentences of the greatest depth of a word.
        words = self.lexical[self.known[self.lexical]]
        median, n = np.full(self.groups, np.nan), np.zeros(self.groups)
        if len(words):
            begin = np.flatnonzero(_starts(self.seg[words]))
            most, own = np.maximum.reduceat(depth[words], begin), self.group[words[begin]]
            most = most[np.lexsort((most, own))]
            first = np.flatnonzero(_starts(own))
            count = np.diff(np.append(first, len(own)))
            median[own[first]], n[own[first]] = (most[first + (count - 1) // 2] + most[first + count // 2]) / 2, count
        some = np.bincount(self.group[self.lexical], minlength=self.groups) > 0
        return out | {"dependency.maxdepth_median": (median * n, np.where(some, n, np.nan))}

    def reuse(self) -> dict:
        words = self.lexical
        seg, part, group, form, sent = (x[words] for x in (self.seg, self.part, self.group, self.form, self.sent))
        first = np.flatnonzero(seg[2:] == seg[:-2])
        key = pd.factorize(form[first] * (len(self.forms) + 1) + form[first + 1])[0]
        key = pd.factorize(key * (len(self.forms) + 1) + form[first + 2])[0]
        key = pd.factorize(key * (len(self.first) + 1) + part[first])[0]
        earliest = np.zeros(len(first), np.int64)
        earliest[key[::-1]] = sent[first][::-1]
        out = {"lexical.trigram_reuse": self._part(group[first], (earliest[key] < sent[first]).astype(float))}

        tags = self.upos[words]
        first = first[_starts(seg)[first]]
        most = len(self.tags) + 1
        key = pd.factorize(((tags[first] * most + tags[first + 1]) * most + tags[first + 2]) * (len(self.first) + 1) + part[first])[0]
        later = ~_starts(part[first])
        out["syntax.initial_pos_reuse"] = self._part(group[first][later], pd.Series(key).duplicated().to_numpy()[later].astype(float))

        wide = len(self.forms) + 1
        content = np.unique((seg * wide + form)[(_of(self.tags, ("NOUN", "PROPN", "VERB", "ADJ")) < 4)[tags]])
        owner = content // wide
        size = np.bincount(owner, minlength=len(self.first))
        common = np.bincount(owner[self._find(content, content - wide) >= 0], minlength=len(self.first))
        begin = self.first
        near = np.zeros(len(begin), bool)
        near[1:] = (self.part[begin][1:] == self.part[begin][:-1]) & (self.sent[begin][1:] == self.sent[begin][:-1] + 1)
        either = size - common
        either[1:] += size[:-1]
        near &= either > 0
        out["lexical.content_overlap"] = self._part(self.group[begin][near], common[near] / either[near])
        return out

    def _part(self, group: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the hits and number of rows by group; nothing where there are none."""
        n = np.bincount(group, minlength=self.groups).astype(float)
        return np.where(n > 0, np.bincount(group, hits, self.groups), np.nan), np.where(n > 0, n, np.nan)

    def windowed(self, k: int) -> dict:
        """Over all windows of ``k`` words of a component: type share, and entropies by what each step of the window changes."""
        words = self.lexical
        part = (self.seg if self.by_sentence else self.part)[words]
        words = words[np.bincount(part, minlength=1)[part] >= k]
        part = np.cumsum(_starts((self.seg if self.by_sentence else self.part)[words])) - 1 if len(words) else words
        begin = np.flatnonzero(_starts(part)) if len(words) else words
        size = np.diff(np.append(begin, len(words)))
        group, windows = self.group[words[begin]], (size - k + 1).astype(float)

        def total(values: np.ndarray, part: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
            """Sums over the windows of each part of the entropy, and for every value the index of the one before, -1 for none."""
            n = len(values)
            begin = np.flatnonzero(_starts(part))
            size = np.diff(np.append(begin, n))
            i, m = np.arange(n) - begin[part], n + 1
            key = (part * (int(values.max()) + 1) + values) * m
            spot = np.arange(n)
            ordered = np.sort(key + spot)
            place = np.empty(n, np.int64)
            at = ordered % m
            place[at] = spot
            before = np.full(n, -1)
            same = ordered[1:] - at[1:] == ordered[:-1] - at[:-1]
            before[at[1:][same]] = i[at[:-1][same]]
            bits = np.concatenate(([0.0], np.arange(1, width + 1) * np.log2(np.arange(1, width + 1))))
            count = place - np.searchsorted(ordered, key + np.maximum(spot - width + 1, 0))
            step = bits[count + 1] - bits[count]
            full = np.flatnonzero(i >= width)
            gone = full - width
            count = np.searchsorted(ordered, key[gone] + full - 1, "right") - place[gone]
            step[full] += bits[count - 1] - bits[count]
            changed = np.bincount(part, step * (size[part] - np.maximum(i, width - 1)))
            return (size - width + 1) * np.log2(width) - changed / width, before

        if not len(words):
            nothing = np.full(self.groups, np.nan)
            return {name: (nothing, nothing) for name in ("lexical.mattr100", "lexical.entropy100", "upos.bigram_entropy100")}
        entropy, before = total(self.form[words], part, k)
        i, n = np.arange(len(words)) - begin[part], size[part]
        kinds = np.bincount(part, np.maximum(0, np.minimum(i, n - k) - np.maximum(np.maximum(i - k + 1, before + 1), 0) + 1)) / k
        tags = self.upos[words]
        pair = np.flatnonzero(part[1:] == part[:-1])
        bigrams, _ = total(tags[pair] * len(self.tags) + tags[pair + 1], part[pair], k - 1)
        n = np.bincount(group, windows, self.groups)
        summed = lambda x: (np.where(n > 0, np.bincount(group, x, self.groups), np.nan), np.where(n > 0, n, np.nan))
        return {"lexical.mattr100": summed(kinds), "lexical.entropy100": summed(entropy / np.log2(k)), "upos.bigram_entropy100": summed(bigrams / np.log2(289))}


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of at least ``CHUNK`` tokens, except the last, none of which parts a document."""
    held: list[pa.RecordBatch] = []
    rows, wanted = 0, CHUNK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        codes, _ = _codes(table.column("doc_id").combine_chunks() if table.column("doc_id").num_chunks != 1 else table.column("doc_id").chunk(0))
        cut = int(np.flatnonzero(_starts(codes))[-1])
        if cut:
            yield table.slice(0, cut)
            held, rows, wanted = table.slice(cut).to_batches(), table.num_rows - cut, CHUNK
        if rows >= wanted:
            wanted = 2 * rows
    if rows:
        yield pa.Table.from_batches(held)


def measurer(classes: tuple[np.ndarray, np.ndarray], names: tuple[str, ...], by: tuple[str, ...], k: int, fixed: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function for ``mapInArrow``: ``by`` and the arrays of numerators and denominators of ``names``; null where a channel has no row. States follow where tokens have flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bits = classes
        table = np.repeat(bits, np.diff(np.append(starts, 0x110000)))
        for rows in whole_documents(batches):
            chunk = Chunk(rows, table, "sent" in by)
            kinds = ((("upos.", "deprel.", "word", "cue."), lambda: chunk.shares(*fixed)), (("dependency.", "syntax."), chunk.dependencies), (("lexical.", "syntax.initial"), chunk.reuse), (("lexical.", "upos.bigram"), lambda: chunk.windowed(k)))
            made: dict = {}
            for prefixes, measure in kinds:
                if any(x.startswith(prefixes) and x not in made for x in names):
                    made |= measure()
            lists = []
            for side in (0, 1):
                flat = np.stack([made[x][side] for x in names], axis=1)
                lists.append(pa.ListArray.from_arrays(np.arange(0, flat.size + 1, len(names), dtype=np.int32), pa.array(flat.ravel(), from_pandas=True)))
            own = rows.select(list(by)).take(pa.array(chunk.leaders)).combine_chunks()
            states = {} if chunk.flags is None else {"flags": pa.array(chunk.states())}
            yield pa.RecordBatch.from_arrays([*(own.column(c).chunk(0) for c in by), *lists, *states.values()], [*by, "n", "d", *states])

    return run
