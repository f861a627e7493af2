"""Sampled suffixes of strings of bytes or words: anchors chosen by content, and hashes of any substring."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.hashing import mix64

_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
#: A random number for each byte.
BYTES = mix64(np.arange(256), 17)


class SubstringHashes:
    """64-bit hashes of substrings of a buffer of random numbers, one for each symbol: equal substrings, wherever they stand, have equal hashes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(self.up):
            for name, base in (("up", _BASE), ("down", _BACK)):
                powers = np.full(len(data) + 1, base, np.uint64)
                powers[0] = 1
                setattr(SubstringHashes, name, np.multiply.accumulate(powers))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * self.up[: len(data)], dtype=np.uint64)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts]) + (ends - starts).astype(np.uint64)

    def every(self, length: int) -> np.ndarray:
        """Of the substring of that length at each start."""
        n = len(self.sums) - length
        return mix64((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def anchors(data: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cover all windows of `length` symbols of the texts data[first:last] by anchors.

    A window's anchor is the half-length substring in it of least hash, the leftmost of equal ones; equal windows have
    it at the same place. Returned for each run of windows that share an anchor: text, lo, hi (first and last window
    start), hash of the anchor's substring, hash of all that the run's windows cover and of where the anchor is in it.
    """
    half = length // 2
    hashes, reach = SubstringHashes(data), length - half + 1
    grams = hashes.every(half)
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return empty
    if len(data) >= 1 << 24:
        raise ValueError("a buffer of anchors must stay under 16 MiB")
    low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    starts = np.arange(len(low))
    text = np.searchsorted(firsts, starts, "right") - 1
    inside = starts + length <= lasts[text]
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    starts, at, text = starts[inside], at[inside], text[inside]
    if not len(starts):
        return empty
    fresh = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    edge = np.flatnonzero(fresh)
    lo, hi, at, text = starts[edge], starts[np.append(edge[1:], len(starts)) - 1], at[edge], text[edge]
    around = mix64(hashes.of(lo, hi + length)) + (at - lo).astype(np.uint64)
    return text, lo, hi, grams[at], around
