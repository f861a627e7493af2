"""Approximate nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample turns unit vectors into binary codes that keep their angles as well as signs
can. The codes of a block are cut into substrings, and each substring position has an index from its value to the
codes that have it; a block's indexes are built once and written. Codes within r of a query's are so near to it at one
position at least that probing all substring values that near (see probed) retrieves every code within r; those are
reranked by cosine on the floats. Where neighbours are hardly nearer than others, as among random vectors, the radius
is large and the probes reach most codes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks

#: Vectors of a length that the rotation and the radius are learned from, at most.
SAMPLE = 4_096


def learn(sample: np.ndarray, *, bits: int = 128, reach: float = 0.96, k: int = 5, rounds: int = 40) -> tuple[np.ndarray, int]:
    """Rotations (dims x bits, side by side) and the radius that reaches a share `reach` of the sample's k nearest neighbours."""
    rng = np.random.default_rng(0)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    dims = unit.shape[1]
    turns = []
    for _ in range(-(-bits // dims)):
        r = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(unit @ r).T @ unit)
            r = (u @ v).T
        turns.append(r)
    rotation = np.concatenate(turns, 1)[:, :bits]
    code, asked = encode(unit, rotation), np.arange(0, len(unit), max(1, len(unit) // 500))
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
    apart = np.bitwise_count(code[asked][:, None] ^ code[best]).sum(-1, dtype=np.int64)
    return rotation, int(np.ceil(np.quantile(apart, reach))) if apart.size else bits


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words."""
    signs = np.zeros((len(vectors), -(-rotation.shape[1] // 64) * 64), bool)
    signs[:, : rotation.shape[1]] = vectors @ rotation > 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64).reshape(len(vectors), -1)


@lru_cache(maxsize=64)
def masks(width: int, reach: int) -> np.ndarray:
    """All values of `width` bits with at most `reach` set."""
    values = np.arange(1 << width, dtype=np.uint64)
    return values[np.bitwise_count(values) <= reach].astype(np.int64)


class MultiIndex:
    """Codes cut into substrings of up to 16 bits, each position with an index from its value to the codes that have it."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.parts = codes, []
        width = min(16, max(6, int(np.log2(max(len(codes), 1)))))
        for word in range(codes.shape[1]):
            own = min(64, bits - 64 * word)
            m = max(1, -(-own // width))
            edges = np.linspace(0, own, m + 1).round().astype(int)
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                value = self.cut(codes, word, low, high - low)
                order = np.argsort(value, kind="stable")
                self.parts.append((word, low, high - low, order, np.searchsorted(value[order], np.arange((1 << (high - low)) + 1))))

    @staticmethod
    def cut(codes: np.ndarray, word: int, low: int, width: int) -> np.ndarray:
        return ((codes[..., word] >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of the codes that some position's index gives.

        Codes within the radius differ in at most t bits at one position with bound t, as long as the bounds and one
        more for each position sum up to more than the radius: the positions share the radius less their number.
        """
        hit, m = np.zeros(len(self.codes), bool), len(self.parts)
        share, more = divmod(max(radius - m + 1, 0), m) if radius >= m else (0, 0)
        bounds = [share + (i < more) for i in range(m)] if radius >= m else [0] * (radius + 1)
        for (word, low, width, order, starts), bound in zip(self.parts, bounds, strict=False):
            at = masks(width, min(width, bound)) ^ int(self.cut(code, word, low, width))
            first, size = starts[at], starts[at + 1] - starts[at]
            full = size > 0
            first, size = first[full], size[full]
            ends = np.cumsum(size)
            run = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(first, size)
            hit[order[run]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius."""
        found = self.probed(code, radius)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1, dtype=np.int64) <= radius]


class Block:
    """A block's index and its vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.index = MultiIndex(encode(vectors, rotation), rotation.shape[1])


def finder(learned: dict[int, tuple[np.ndarray, int]]):
    """The functions that blocks.search takes: an index of a block, and its nearest to queries; learned: rotation and radius by length."""

    def prepare(ids, vectors):
        return Block(ids, vectors, learned[vectors.shape[1]][0])

    def find(block, query_ids, query_vectors, thresholds, k):
        ids, vectors, norms = block.ids, block.vectors, block.norms
        rotation, radius = learned[vectors.shape[1]]
        bits = rotation.shape[1]
        query_norms, asked = np.sqrt((query_vectors * query_vectors).sum(1)), encode(query_vectors, rotation)
        out = []
        for i, code in enumerate(asked):
            for r in range(radius, bits + 8, 8):  # farther where too few are near
                found = block.index.within(code, min(r, bits))
                found = found[ids[found] != query_ids[i]]
                if len(found) >= k or r >= bits:
                    break
            rough = vectors[found] @ query_vectors[i] / (norms[found] * query_norms[i])
            near = rough >= thresholds[i] - 1e-9
            found, rough = found[near], rough[near]
            if len(found) > k:
                found = found[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
            # summed row by row, so that equal vectors get equal scores
            score = (vectors[found] * query_vectors[i]).sum(1) / (norms[found] * query_norms[i])
            best = blocks.top(score, ids[found], k)
            out.append((np.full(len(best), query_ids[i]), ids[found][best], score[best]))
        q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return {"query_id": q, "vec_id": v, "score": s}

    return prepare, find


def nearest(candidates: DataFrame, queries: DataFrame, *, k: int = 5, bits: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k nearest found by cosine (double precision).

    Both need vec_id and embedding. A candidate with the query's own vec_id is left out. Vectors that are null, empty,
    zero, or hold null or non-finite components take no part, nor do rows without vec_id; a query is compared with the
    candidates of its own length. Repeated rows are candidates each; a repeated query asks once. Every row is indexed;
    the rotation and the radius come from SAMPLE rows of each length at most, those of least hash. A block in which fewer than k codes lie
    within the radius is searched farther, so a query gets all candidates if there are fewer than k. Ties go to the
    smaller vec_id. Empty tables: no rows.
    """
    nonzero = F.exists("embedding", lambda x: x != 0)
    pool, asked = blocks.usable(candidates).where(nonzero), blocks.usable(queries).where(nonzero)
    learned = {}
    for d in sorted(r["d"] for r in pool.select("d").distinct().collect()):
        rows = pool.where(F.col("d") == d).orderBy(F.xxhash64("_at", F.lit("mih")), "_at").limit(SAMPLE).select("vec_id", "embedding").toArrow()
        # copies of one vector would teach the radius nothing
        learned[d] = learn(np.unique(blocks.matrix(rows)[1], axis=0), bits=bits, k=k)
    return blocks.search(pool, asked, *finder(learned), k, "score double", -2.0)


def op5(spark, sf_dir: str) -> DataFrame:
    """nearest over embeddings, asked by every vec_id divisible by 50. Nulls, ties, repeated rows and empty tables as there; other columns are not looked at."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
