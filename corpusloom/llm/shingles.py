"""Word shingle sets of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpusloom.llm.hashing import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_BYTES = mix64(np.arange(256), 3)
#: A-Z count as a-z.
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed together.
TOGETHER = 1 << 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes of the distinct runs of `words` words of each text; a shorter text's whole sequence is its only shingle."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, _powers(_BASE, 1), _powers(_BACK, 1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [x for part in self._parts(texts) for x in self._sets(*self._words(part))]

    def word_hashes(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text the hashes of its words, in order."""
        out = []
        for part in self._parts(texts):
            words, at = self._words(part)
            out += [words[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def _parts(self, texts: list[str]) -> Iterator[list[bytes]]:
        part, size = [], 0
        for text in texts:
            data = text.encode()
            if part and size + len(data) > TOGETHER:
                yield part
                part, size = [], 0
            part.append(data)
            size += len(data) + 1
        if part:
            yield part

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text's begin and end."""
        data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(_BASE, len(data)), _powers(_BACK, len(data))
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * self.up[: len(data)], dtype=np.uint64)))
        words = mix64((sums[ends] - sums[starts]) * self.down[starts]) + (ends - starts).astype(np.uint64)
        return words, np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))

    def _sets(self, words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        runs = words
        for k in range(1, self.words):
            runs = mix64(runs[: len(words) - k]) * np.uint64(_BASE) + words[k:]
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= self.words:
                out.append(np.unique(runs[a : b - self.words + 1]))
            elif b > a:
                h = words[a : a + 1]
                for w in words[a + 1 : b]:
                    h = mix64(h) * np.uint64(_BASE) + w
                out.append(mix64(h, b - a))
            else:
                out.append(words[:0])
        return out
