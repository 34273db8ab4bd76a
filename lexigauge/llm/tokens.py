"""Problem 6: a corpus encoded with a public byte-level BPE vocabulary.

Words are cut into pieces between which no vocabulary entry can reach, each
piece is merged with a segment tree that holds the leftmost pair of lowest
rank, and results are kept per worker for pieces seen before.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: White space as the vocabulary's pattern means it (the Unicode property, without U+001C to U+001F).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The vocabulary's pattern for words.
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: A word never reaches over the start of such a chunk, so chunks can be looked up whole.
_CHUNKS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")

_NONE = 1 << 62


class Encoder:
    """Ids of texts by one rank file. ``kept`` bounds the entries of each cache."""

    def __init__(self, path: str, kept: int = 400_000):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.kept = kept
        self._crossing: dict[tuple[int, int], list[tuple[bytes, bytes]]] = {}
        for token in self.ranks:
            if len(token) > 1 and not token.isascii():
                for i in range(1, len(token)):
                    self._crossing.setdefault((token[i - 1], token[i]), []).append((token[max(0, i - 4) : i], token[i : i + 4]))
        self._cuts = _Kept(self._cut, kept)
        self._pieces = _Kept(self._piece, kept)
        self._word_ids = _Kept(self._word, kept)
        self._chunk_ids = _Kept(self._chunk, kept)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        known = self._chunk_ids
        return b"".join([known[c] for c in _CHUNKS.findall(text)])

    def _chunk(self, chunk: str) -> bytes:
        words = self._word_ids
        return b"".join([words[w] for w in _WORDS.findall(chunk)])

    def _word(self, word: str) -> bytes:
        pieces = self._pieces
        if word.isascii():
            return pieces[word]
        out, start, cuts = [], 0, self._cuts
        for i in range(1, len(word)):
            if cuts[word[i - 1 : i + 1]]:
                out.append(pieces[word[start:i]])
                start = i
        out.append(pieces[word[start:]])
        return b"".join(out)

    def _cut(self, pair: str) -> bool:
        """Whether no entry of the vocabulary reaches over the boundary between two characters."""
        left, right = (c.encode("utf-8", "replace") for c in pair)
        if pair.isascii():
            return False
        for a, b in self._crossing.get((left[-1], right[0]), ()):
            if (left.endswith(a) or a.endswith(left)) and (right.startswith(b) or b.startswith(right)):
                return False
        return True

    def _piece(self, piece: str) -> bytes:
        return np.asarray(self.merge(piece.encode("utf-8", "replace")), "<i4").tobytes()

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word's bytes: merge the leftmost pair of lowest rank until none is left.

        The tree's leaf ``i`` holds ``rank * n + i`` for the pair that starts at
        the live byte position ``i``; its root is the pair to merge next. A merge
        changes three leaves, each in a logarithmic number of steps.
        """
        ranks, n = self.ranks, len(data)
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        size = 1 << max(0, n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            rank = ranks.get(data[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        def pair(i: int) -> int:
            middle = end[i]
            if middle >= n:
                return _NONE
            rank = ranks.get(data[i : end[middle]])
            return _NONE if rank is None else rank * n + i

        while (low := tree[1]) != _NONE:
            i = low % n
            gone = end[i]
            end[i] = end[gone]
            if end[i] < n:
                before[end[i]] = i
            if gone < n - 1:
                put(gone, _NONE)
            if i < n - 1:
                put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out


class _Kept(dict):
    """Values of ``make`` by key; emptied when it holds ``most`` entries, and keys of over 96 characters stay out."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 96:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_encoders: dict[str, Encoder] = {}


def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """The worker's encoder of a rank file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(id_col, ids)`` for every row of ``df``.

    Null text: null ids. Empty text: an empty list. Strings that look like
    special tokens are ordinary text. Repeated rows and null ids stay as they
    are; other columns of ``df`` are not read. Texts may have any length.
    """
    narrow = df.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            parts = [None if t is None else own.encode(t) for t in batch.column(1).to_pylist()]
            lengths = np.fromiter((0 if p is None else len(p) // 4 for p in parts), np.int64, len(parts))
            values = np.frombuffer(b"".join([p for p in parts if p]), "<i4")
            stops = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(stops), pa.array(values, pa.int32()), mask=pa.array([p is None for p in parts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
