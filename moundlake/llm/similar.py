"""64-bit hashes of the word shingles of whole texts."""

from __future__ import annotations

import numpy as np

# Bytes hashed at a time, which bounds the memory for one very long text.
CHUNK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 3
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mapping of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words and shingles, from running sums over the bytes of a text."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, powers(BASE, 1 << 12), powers(INVERSE, 1 << 12)

    def word_hashes(self, low: bytes) -> np.ndarray:
        out, at = [], 0
        while at < len(low):
            stop = min(at + CHUNK, len(low))
            while stop < len(low) and not SPACE[low[stop]]:
                stop += 1
            out.append(self.chunk(np.frombuffer(low, np.uint8, stop - at, at)))
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def chunk(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self.up):
            self.up, self.down = powers(BASE, 2 * len(data)), powers(INVERSE, 2 * len(data))
        inside = np.concatenate([[False], ~SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[data] * self.up[: len(data)], dtype=np.uint64)])
        return mixed((sums[last] - sums[first]) * self.down[first] + (last - first).astype(np.uint64))

    def shingles(self, text: bytes) -> np.ndarray:
        """Distinct hashes of the runs of ``words`` words, sorted; a shorter text is one shingle, one without words has none."""
        each = self.word_hashes(text.lower())
        if not len(each):
            return each
        runs = max(len(each) - self.words + 1, 1)
        total = np.zeros(runs, np.uint64)
        for k in range(min(self.words, len(each))):
            total = total * np.uint64(BASE) + each[k : k + runs]
        return np.unique(mixed(total + np.uint64(min(self.words, len(each)))))


def set_hash(shingles: np.ndarray) -> int:
    """One number for equal sets."""
    return int(mixed(np.array([mixed(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])
