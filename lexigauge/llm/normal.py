"""Text reduced to letters and digits, and hashes of its character runs."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_OTHER = re.compile(r"[\W_]+")


def letters_digits(text: str) -> str:
    """NFKC, lower case, only letters and digits."""
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).lower())


def lettered(text: str) -> bool:
    """Whether ``text`` holds a letter."""
    return any(unicodedata.category(c)[0] == "L" for c in text)


def offsets(text: str) -> tuple[str, list[int]]:
    """:func:`letters_digits` of ``text`` with, for each of its characters, the code point of ``text`` it comes from.

    The text is normalised cluster by cluster (a character with its combining
    marks), so composed characters map to the start of their cluster.
    """
    pieces, where, start, n = [], [], 0, len(text)
    while start < n:
        end = start + 1
        while end < n and (unicodedata.combining(text[end]) or "\u1160" <= text[end] <= "\u11ff"):
            end += 1
        piece = unicodedata.normalize("NFKC", text[start:end])
        pieces.append(piece)
        for c in piece:
            where += [start] * len(c.lower())
        start = end
    # The whole is lowered at once, since a sigma at the end of a word is another letter.
    lower = "".join(pieces).lower()
    kept = [(c, w) for c, w in zip(lower, where) if c != "_" and not _OTHER.match(c)]
    return "".join(c for c, _ in kept), [w for _, w in kept]


def run_hashes(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` characters; a shorter text is one run."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64)
    count = max(1, len(codes) - width + 1)
    h = np.zeros(count, np.uint64)
    for i in range(min(width, len(codes))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + count] + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
