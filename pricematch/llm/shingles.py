"""Word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, made when first asked for; at most about ``limit`` are kept."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(raw: bytes) -> list[bytes]:
    """A-Z in lower case, cut at the six ASCII blanks; other letters stay as they are."""
    return raw.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIER
    return x ^ (x >> np.uint64(29))


def shingle_row(hashes: np.ndarray, width: int) -> np.ndarray:
    """The shingle at each word that begins one; fewer words than ``width`` make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : n - width + 1 + k])
    return out


def shingle_set(raw: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a text, in order of their hash."""
    return np.unique(shingle_row(hashes.of(words_of(raw)), width))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
