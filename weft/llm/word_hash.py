"""Hashes of words and of runs of words, in numpy: the same for the same words wherever they stand."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker remembers before it starts afresh.
MEMO = 150_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but a space and the characters 9 to 13, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[2]
    x = (x ^ (x >> np.uint64(27))) * _C[3]
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    return mixed(a * _C[0] + (b ^ np.uint64(lane + 1)) * _C[1])


def run_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` words: element i stands for the run that starts at word i.

    Runs of 1, 2, 4, 8 … words are hashed by doubling, and ``length`` is put together from those.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, at, found = mixed(words + np.uint64(lane)), 1, 0, None
    while size <= length:
        if length & size:
            part = level[at : at + n]
            found = part if found is None else pair(found, part, lane)
            at += size
        if size * 2 <= length:
            level = pair(level[:-size], level[size:], lane)
        size *= 2
    return found


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
