"""Prefix-tree similarity join of sets held in memory."""

from __future__ import annotations

import numpy as np

#: Tokens of a branch that are compared before its bound is looked at again.
STRIDE = 32


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b at which 100 * overlap >= percent * union."""
    return -((-percent * (a + b)) // (100 + percent))


class UnionFind:
    def __init__(self, n: int):
        self.parent, self.parts = list(range(n)), n

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parts -= 1
        return True


class Trie:
    """A path-compressed trie of sets whose tokens all follow one global order.

    A node stands for the tokens [start, end) that the sets lo..hi-1 (in lexicographic order) have in common.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.tokens = np.concatenate(self.sets) if sets else np.zeros(0, np.uint64)
        common = np.zeros(len(sets) + 1, np.int64)
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            n = min(len(a), len(b))
            apart = np.flatnonzero(a[:n] != b[:n])
            common[i] = apart[0] if len(apart) else n
        rows, todo = [], [(0, len(sets), 0, -1)] if sets else []
        while todo:
            lo, hi, start, parent = todo.pop()
            end = int(self.sizes[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
            me = len(rows)
            rows.append((lo, hi, start, end, parent))
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
                todo += [(a, b, end, me) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.lo, self.hi, self.start, self.end, self.parent = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        by_parent = np.argsort(self.parent, kind="stable")
        self.children = by_parent
        self.first_child = np.searchsorted(self.parent[by_parent], np.arange(len(rows)))
        self.n_children = np.searchsorted(self.parent[by_parent], np.arange(len(rows)), "right") - self.first_child
        self.least = np.array([self.sizes[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)
        self.most = np.array([self.sizes[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)], np.int64)

    def similar(self, probe: np.ndarray, percent: int, after: int = -1) -> np.ndarray:
        """Places (in the trie's order) beyond `after` of the sets that are similar to probe.

        All branches are walked together. What a branch's tokens have in common with the probe is counted once for
        all sets below it, and a branch goes when that count and all that can follow on both sides are too few for
        its smallest set, or when none of its sets has a fitting size.
        """
        n, found = len(probe), []
        if not len(self.lo) or not n:
            return np.zeros(0, np.int64)
        node, at, shared = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            fits = (self.hi[node] > after + 1) & (100 * self.most[node] >= percent * n) & (100 * n >= percent * self.least[node])
            node, at, shared = node[fits], at[fits], shared[fits]
            span = np.minimum(self.end[node] - at, STRIDE)
            steps = np.arange(int(span.max()) if len(span) else 0)
            live = steps[None] < span[:, None]
            where = (self.offsets[self.lo[node]] + at)[:, None] + steps[None]
            token = self.tokens[np.minimum(where, len(self.tokens) - 1)]
            place = np.searchsorted(probe, token)
            hit = live & (probe[np.minimum(place, n - 1)] == token)
            shared = shared + hit.sum(1)
            at = at + span
            passed = np.zeros(len(node), np.int64)
            moved = np.flatnonzero(span)
            passed[moved] = np.searchsorted(probe, token[moved, span[moved] - 1], "right")
            reach = shared + np.minimum(self.most[node] - at, n - passed)
            keep = reach >= needed(n, np.maximum(self.least[node], -(-percent * n // 100)), percent)
            node, at, shared = node[keep], at[keep], shared[keep]
            ended = at >= self.end[node]
            leaf = ended & (self.hi[node] - self.lo[node] == 1)
            hits = self.lo[node[leaf]]
            found.append(hits[(100 * shared[leaf] >= percent * (n + self.sizes[hits] - shared[leaf])) & (hits > after)])
            inner = ended & ~leaf
            fan = self.n_children[node[inner]]
            down = np.repeat(self.first_child[node[inner]], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
            going = ~ended
            child = self.children[down]
            node = np.concatenate((node[going], child))
            at = np.concatenate((at[going], self.start[child]))
            shared = np.concatenate((shared[going], np.repeat(shared[inner], fan)))
        return np.concatenate(found)


def link(sets: list[np.ndarray], percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of places that, together with equal groups, connect all sets that similar sets connect.

    A pair is given only where it joins two parts, so there are fewer pairs than sets however many are similar.
    """
    union, out = UnionFind(len(sets)), []
    if groups is not None:
        first: dict[int, int] = {}
        for i, g in enumerate(groups):
            union.union(first.setdefault(g, i), i)
    trie = Trie(sets)
    for place, i in enumerate(trie.order):
        if union.parts == 1:
            break
        for other in trie.similar(sets[i], percent, after=place).tolist():
            if union.union(i, j := trie.order[other]):
                out.append((i, j))
    return out
