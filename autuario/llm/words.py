"""Words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Odd multipliers of the polynomial hashes.
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters worked on at a time; bounds the memory of a task, whatever the texts' lengths.
CHARS = 1_500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _alnum() -> np.ndarray:
    """Whether each code point is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0, 1, ... n - 1, modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(texts: list[str | None], chars: int = CHARS) -> Iterator[range]:
    """Ranges of texts of about ``chars`` characters together; a longer text stands alone."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        k = len(t) if t else 0
        if n and n + k > chars:
            yield range(start, i)
            start, n = i, 0
        n += k
    if start < len(texts):
        yield range(start, len(texts))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text in order: (index of the text, 64-bit hash of the word).

    Words are maximal runs of letters and digits, in lower case.
    """
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low)))
    is_word = np.concatenate([[False], _alnum()[codes], [False]])
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    length = last - first
    inside = codes[is_word[1:-1]].astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(inside)) - np.repeat(starts, length)
    inside *= powers(_P, int(length.max()))[place]
    return np.searchsorted(ends, first, side="right"), mix(np.add.reduceat(inside, starts) + length.astype(np.uint64) * _Q)


def sequence_hashes(doc: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each text's whole sequence of words; 0 for a text without words."""
    out = np.zeros(n, np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        length = np.diff(np.concatenate([first, [len(doc)]]))
        place = np.arange(len(doc)) - np.repeat(first, length)
        out[doc[first]] = mix(np.add.reduceat(word * powers(_Q, int(length.max()))[place], first) + length.astype(np.uint64))
    return out


def shingle_hashes(doc: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, hash) of every run of ``size`` words; a run that recurs in its text recurs here."""
    if len(doc) < size:
        return doc[:0], word[:0]
    n = len(doc) - size + 1
    h = word[:n].copy()
    for k in range(1, size):
        h = mix(h) + word[k : k + n] * _P
    same = doc[:n] == doc[size - 1 :]
    return doc[:n][same], mix(h)[same]
