"""64-bit hashes over numpy arrays, and a minimal perfect hash built from them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed values of the splitmix64 generator.
_GOLDEN, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser of each value."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _GOLDEN * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def hash_bytes(keys: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(k) for k in keys), np.uint64, len(keys))


class MinimalPerfectHash:
    """Maps n distinct 64-bit hashes to 0..n-1 without storing them.

    Level by level, each remaining hash picks a bit of a table twice as large as their number; those that are alone
    on their bit settle there, the others go to the next level. A hash's number is the count of settled bits before
    its own. What is left after the last level (none in practice) is kept as a sorted array.
    A foreign hash gets -1 or any number: compare with a stored fingerprint or key.
    """

    LEVELS = 24

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray, n: int):
        self.levels, self.rest, self.n = levels, rest, n

    @classmethod
    def build(cls, hashes: np.ndarray) -> MinimalPerfectHash:
        left, done, levels = hashes.astype(np.uint64), 0, []
        for level in range(cls.LEVELS):
            if not len(left):
                break
            size = max(64, (2 * len(left) + 63) // 64 * 64)
            at = (mix64(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = done + np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            levels.append((words, ranks.astype(np.int64)))
            settled = alone[at]
            done += int(settled.sum())
            left = left[~settled]
        return cls(levels, np.sort(left), done + len(left))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        hashes = hashes.astype(np.uint64)
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (words, ranks) in enumerate(self.levels):
            if not len(left):
                return out
            at = mix64(hashes[left], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            number = ranks[word] + np.bitwise_count(below)
            out[left[hit]] = number[hit]
            left = left[~hit]
        if len(left) and len(self.rest):
            place = np.minimum(np.searchsorted(self.rest, hashes[left]), len(self.rest) - 1)
            found = self.rest[place] == hashes[left]
            out[left[found]] = self.n - len(self.rest) + place[found]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.levels), len(self.rest), *(len(w) for w, _ in self.levels)], "<i8")
        return b"".join([head.tobytes(), *(w.tobytes() + r.tobytes() for w, r in self.levels), self.rest.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalPerfectHash:
        n, count, rest = (int(x) for x in np.frombuffer(data, "<i8", 3))
        sizes, at, levels = np.frombuffer(data, "<i8", count, 24), 24 + 8 * count, []
        for size in map(int, sizes):
            levels.append((np.frombuffer(data, np.uint64, size, at), np.frombuffer(data, np.int64, size, at + 8 * size)))
            at += 16 * size
        return cls(levels, np.frombuffer(data, np.uint64, rest, at), n)
