"""Words and word shingles as 64-bit numbers; plain numpy, for use inside Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; remembers up to `most` words."""

    def __init__(self, seed: int = 0, most: int = 300_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.most:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words; for fewer words than n, one hash for all of them; none for none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, (n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for i in range(n):
        out ^= words[i : len(words) - n + 1 + i]
        out *= _MIX
        out ^= out >> _SHIFT
        out *= _MIX
    return out ^ (out >> _SHIFT)


def split_words(text: str | None, lower: bool) -> list[bytes]:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()  # bytes: only A-Z are lower-cased, only ASCII white space splits
