"""Words and word n-grams of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets everything when it holds `most` words, so that memory stays bounded."""

    def __init__(self, most: int = 1 << 17):
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of the text, A-Z lower-cased. bytes.split cuts at exactly the six separators."""
        ws = text.encode("utf-8").lower().split()
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that starts at each word; with fewer than n words, of the whole sequence; of no words, none."""
    k = min(n, len(words))
    if k == 0:
        return np.empty(0, np.uint64)
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _A + words[i : len(words) - k + 1 + i]
        h ^= h >> np.uint64(29)
    return mix64(h)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    return np.unique(ngrams(words, n))
