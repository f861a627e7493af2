"""Exact top-k search by aggregation of sorted lists without random access.

Every dimension's values stand in a sorted list. A query reads the lists of its positive weights from the top and
those of its negative weights from the bottom, all to the same depth, and adds up what they show of each candidate. A
candidate's score lies between that sum plus the least that its unread lists hold, and the same sum plus what the
lists' frontiers allow. The threshold is the k-th highest lower bound, or the k-th best score in a first block of
candidates, which all other blocks share, if that is higher. A query reads until no unseen candidate can reach the
threshold and few seen ones can; those few read their remaining lists, and their scores are final. Where that never
comes about, the lists are read to their ends, and the sums are the scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks

#: Parts that the lists are read in; bounds are compared after each, once outsiders are out.
STEPS = 16
#: Candidates whose bounds are looked at before all others'.
PROBE = 256


class SortedLists:
    """The lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, n = ids, len(ids)
        order = np.argsort(values, axis=0, kind="stable")
        #: By dimension, the candidates in ascending order of their values, and these values.
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.listed = np.ascontiguousarray(np.take_along_axis(values, order, axis=0).T)
        self.depths = np.unique(-(-n * np.arange(1, STEPS + 1) // STEPS)).tolist() if n else []


class Reader:
    """One query's reading of a block's lists."""

    def __init__(self, lists: SortedLists, weights: np.ndarray, bounds: bool):
        self.lists, self.depth = lists, 0
        self.up, self.down = np.flatnonzero(weights > 0), np.flatnonzero(weights < 0)
        self.dims = np.concatenate([self.up, self.down])
        self.weights = weights[self.dims]
        n = len(lists.ids)
        #: Whether sums of products are exact in floats; else they are added as integers.
        most = float(np.abs(lists.listed).max(initial=0)) * float(np.abs(weights).max(initial=0)) * len(weights)
        self.kind = np.float64 if most < 2**52 else np.int64
        self.seen = np.zeros((len(self.dims), n), bool)
        self.sums = np.zeros(n, self.kind)
        self.least = self.weights * np.concatenate([lists.listed[self.up, 0], lists.listed[self.down, n - 1]]) if n else self.weights
        self.low = np.full(n, self.least.sum(), self.kind) if bounds else None

    def read(self, depth: int) -> None:
        """The entries of all lists from the depth reached to this one."""
        n, before, lists = len(self.lists.ids), self.depth, self.lists
        self.depth = depth
        if not len(self.dims):
            return
        at = np.concatenate([lists.order[self.up, n - depth : n - before], lists.order[self.down, before:depth]])
        shown = np.concatenate([lists.listed[self.up, n - depth : n - before], lists.listed[self.down, before:depth]]) * self.weights[:, None]
        self.seen[np.arange(len(at))[:, None], at] = True
        self._add(self.sums, at, shown)
        if self.low is not None:
            self._add(self.low, at, shown - self.least[:, None])

    def _add(self, into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        if self.kind is np.float64:
            into += np.bincount(at.ravel(), values.ravel().astype(np.float64), len(into))
        else:
            np.add.at(into, at.ravel(), values.ravel())

    def frontiers(self) -> np.ndarray:
        """What each list can still show at most."""
        n, at = len(self.lists.ids), self.depth
        return self.weights * np.concatenate([self.lists.listed[self.up, n - 1 - at], self.lists.listed[self.down, at]])

    def high(self, rows: slice) -> np.ndarray:
        """What the candidates of rows can score at most."""
        return self.sums[rows] + self.frontiers().astype(self.kind) @ ~self.seen[:, rows]

    def resolve(self, alive: np.ndarray) -> np.ndarray:
        """The final scores of a few candidates: they read on in the lists that have not shown them."""
        out = self.sums[alive].astype(np.int64)
        for i, d in enumerate(self.dims.tolist()):
            waiting = np.flatnonzero(~self.seen[i, alive])
            if len(waiting):
                rest = slice(0, len(self.lists.ids) - self.depth) if i < len(self.up) else slice(self.depth, None)
                place = np.full(len(self.lists.ids), -1, np.int32)
                place[alive[waiting]] = waiting
                met = place[self.lists.order[d, rest]]
                out[met[met >= 0]] += self.lists.listed[d, rest][met >= 0] * self.weights[i]
        return out


def top_of_lists(lists: SortedLists, weights: np.ndarray, own: int, given: int, k: int, known: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of at least the k best candidates (not `own`) that reach the threshold, and the depth read; given: a threshold that others have set; known: it comes from k scores, so that lower bounds need not be kept."""
    n, few = len(lists.ids), max(4 * k, len(lists.ids) // 16)
    reader, others = Reader(lists, weights, not known), lists.ids != own
    for depth in lists.depths:
        reader.read(depth)
        if depth == n:
            break
        threshold = given
        if reader.low is not None:
            low = reader.low[others]
            if len(low) > k:
                threshold = max(threshold, int(np.partition(low, len(low) - k)[len(low) - k]))
        if reader.frontiers().sum() >= threshold:
            continue  # a candidate that no list has shown may still qualify
        # the first candidates, dealt by a hash as all are, tell whether the others' bounds are worth a look
        if (reader.high(slice(0, PROBE)) >= threshold).mean() * n > 2 * few:
            continue
        alive = np.flatnonzero((reader.high(slice(None)) >= threshold) & others)
        if len(alive) <= few:
            return alive, reader.resolve(alive), depth
    alive = np.flatnonzero(others)
    return alive, reader.sums[alive].astype(np.int64), n


def no_random_access(lists: SortedLists, query_ids: np.ndarray, query_vectors: np.ndarray, thresholds: np.ndarray, k: int):
    """query_id, vec_id, score and read (entries read of each list) of at least each query's k best that reach its threshold."""
    weights = scaled(query_vectors)
    if len(lists.ids) and len(weights):  # products that do not fit 64 bits are an error
        product(np.abs(lists.listed).max(1, initial=0)[None], np.abs(weights).max(0, initial=0)[None])
    out = []
    for q in range(len(weights) if len(lists.ids) else 0):
        given = int(thresholds[q])
        alive, score, depth = top_of_lists(lists, weights[q], int(query_ids[q]), given, k, given > LEAST)
        reach = score >= given
        alive, score = alive[reach], score[reach]
        best = blocks.top(score, lists.ids[alive], k)
        out.append((np.full(len(best), query_ids[q]), lists.ids[alive[best]], score[best], np.full(len(best), depth)))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


#: The threshold of a query that has none yet.
LEAST = -(2**62)


def product(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Integer products, in floats where those are exact."""
    most = np.abs(values).max(initial=0).astype(float) * np.abs(weights).max(initial=0).astype(float) * values.shape[1]
    if most < 2**52:
        return (values.astype(np.float64) @ weights.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return values @ weights.T


def scaled(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x); a component that does not fit 64 bits is an error."""
    out = np.floor(vectors * 1024)
    if np.abs(out).max(initial=0) >= 2**62:
        raise OverflowError("a component times 1024 does not fit 64 bits")
    return out.astype(np.int64)


def exact_top_k(candidates: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k candidates of highest integer inner product.

    Both need vec_id and embedding; components become floor(1024 * x). A candidate with the query's own vec_id is
    left out. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without
    vec_id; a query is compared with the candidates of its own length. Repeated rows are candidates each; a repeated query asks once. Fewer than k
    candidates: all of them. Ties go to the smaller vec_id. Empty tables: no rows. Products beyond 64 bits: an error.
    read is the number of entries of each list that the row's block was read to, entries the lists' length there.
    """
    def prepare(ids, vectors):
        return SortedLists(ids, scaled(vectors))

    def find(lists, query_ids, query_vectors, thresholds, k):
        q, v, s, read = no_random_access(lists, query_ids, query_vectors, thresholds, k)
        return {"query_id": q, "vec_id": v, "score": s, "read": read, "entries": np.full(len(q), len(lists.ids))}

    return blocks.search(blocks.usable(candidates), blocks.usable(queries), prepare, find, k, "score long, read long, entries long", LEAST)


def op4(spark, sf_dir: str) -> DataFrame:
    """exact_top_k over embeddings, asked by every vec_id divisible by 100. Nulls, ties, repeated rows and empty tables as there; other columns are not looked at."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0)).select("query_id", "rank", "vec_id", "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
