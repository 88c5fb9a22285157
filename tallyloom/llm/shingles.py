"""Word shingles as 64-bit hashes, for the operators on resemblance and containment. Runs in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

KEPT_WORDS = 100_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash; a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes | None, fold: bool = False) -> np.ndarray:
        """Hashes of the text's words, A-Z lower-cased; words are runs of bytes other than space and \\x09-\\x0D.

        fold: the case of all letters is folded instead.
        """
        if not text:
            return _EMPTY
        if fold and not text.isascii():
            text = text.decode("utf-8", "replace").casefold().encode()
        words = text.lower().split()  # bytes: ASCII letters and white space only
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of `width` words in text order; with fewer words the whole sequence is one, without words none."""
    n = len(words)
    if not n:
        return _EMPTY
    w = min(width, n)
    acc = np.full(n - w + 1, w, np.uint64)
    for i in range(w):
        acc = mix(acc * _MUL + words[i : n - w + 1 + i])
    return acc


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles' hashes in ascending order."""
    return np.unique(runs(words, width))
