"""Which texts contain which of many strings, by a join of fingerprints.

Winnowing: of the hashes of all q code points in a row, the smallest of each w neighbouring ones is a seed. A string
of q + w - 1 or more code points has such a window inside, so that every text that contains it has each of its seeds.
A string is looked for by one of them, the one that fewest strings share; what texts and strings share a seed is then
compared. Strings of all lengths are covered by tiers of q = w = 1, 2, 4 ...; only tiers that have strings are computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import md5_hash
from corpusloom.runtime import materialize, ship

#: Tiers: the last one has q = w = 2 ** LAST.
LAST = 5
#: Bytes of strings' seeds that are sent to all tasks, so that texts give out matching seeds only; more are joined by a shuffle.
SEED_BYTES = 8 << 20
#: Code points of texts that are hashed together; a longer text is hashed in pieces that overlap.
TOGETHER = 1 << 20
#: Fixed values of the splitmix64 finaliser.
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def tier_of(length: Column) -> Column:
    """The highest tier whose windows a string of this many code points holds."""
    found = F.lit(0)
    for k in range(1, LAST + 1):
        found = F.when(length >= 2 ** (k + 1) - 1, F.lit(k)).otherwise(found)
    return found


def window_seeds(points: np.ndarray, tiers: list[int]) -> dict[int, np.ndarray]:
    """For each tier the seed of the window that starts at each code point; windows that do not fit have none."""
    out = {}
    with np.errstate(over="ignore"):
        hashes = _mixed(points.astype(np.uint64) + np.uint64(1))
        for k in range(max(tiers, default=-1) + 1):
            if k:  # twice as many code points: two neighbouring hashes of the tier before
                step = 1 << (k - 1)
                hashes = _mixed(hashes[:-step] * np.uint64(0x9E3779B97F4A7C15) + hashes[step:]) if len(hashes) > step else hashes[:0]
            if k in tiers:
                least = hashes
                for j in range(k):
                    least = np.minimum(least[: -(1 << j)], least[1 << j :]) if len(least) > 1 << j else least[:0]
                out[k] = least.view(np.int64)
    return out


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and contents of texts, or of pieces of long ones that overlap by a window, about TOGETHER code points at a time."""
    overlap = 2 ** (LAST + 1) - 2
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - overlap, 1), TOGETHER):
            piece = text[at : at + TOGETHER + overlap]
            if held and size + len(piece) > TOGETHER:
                yield numbers, held
                numbers, held, size = [], [], 0
            numbers.append(i)
            held.append(piece)
            size += len(piece)
    if held:
        yield numbers, held


def seeds(texts: DataFrame, key: str, text: str, tiers: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """key, seed: the seeds of each text in these tiers, most of them once; wanted: the sorted ones that matter, if not all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, pieces in _pieces([t or "" for t in batch["text"].to_pylist()]):
                points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), "<u4")
                owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
                for k, found in window_seeds(points, tiers).items():
                    last = owner[2 ** (k + 1) - 2 :]
                    mine = owner[: len(found)]
                    fresh = mine == last  # the window is in one piece
                    fresh[1:] &= (found[1:] != found[:-1]) | (mine[1:] != mine[:-1]) | ~(mine == last)[:-1]
                    if wanted is not None:
                        at = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
                        fresh &= wanted[at] == found if len(wanted) else False
                    pairs = np.unique(np.stack([np.array(numbers, np.int64)[mine[fresh]], found[fresh]]), axis=1)
                    yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(pairs[0])), pa.array(pairs[1])], ["key", "seed"])

    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {dict(texts.dtypes)[key]}, seed long")


def containing(strings: DataFrame, texts: DataFrame) -> DataFrame:
    """needle, hits: for each distinct string (needle; not null or empty) that any row of texts (norm) contains, the number of rows that do.

    Texts are read twice: for their seeds, and, those that share a seed with a string, to be compared. Equal texts are
    compared once. Seeds that very many texts have cost a comparison each, as texts that contain a string do anyway.
    """
    spark = texts.sparkSession
    ship(spark)
    asked = materialize(strings.select("needle").distinct().withColumn("tier", tier_of(F.length("needle"))), "needles")
    tiers = sorted(r.tier for r in asked.select("tier").distinct().collect())
    if not tiers:
        return asked.select("needle", F.lit(0).cast("long").alias("hits"))
    own = None
    for k in tiers:
        found = seeds(asked.where(F.col("tier") == k), "needle", "needle", [k]).distinct()
        own = found if own is None else own.unionByName(found)
    shared = own.groupBy("seed").agg(F.count("*").alias("n"))
    rarest = own.join(shared, "seed").groupBy("key").agg(F.min_by("seed", F.struct("n", "seed")).alias("seed"))
    looked = materialize(rarest.withColumnRenamed("key", "needle"), "needle-seeds")
    wanted = None
    if 8 * looked.count() <= SEED_BYTES:
        wanted = np.sort(looked.select("seed").distinct().toArrow()["seed"].to_numpy())
    keyed = texts.where("norm is not null and norm <> ''").select(md5_hash(F.col("norm")).alias("tkey"), "norm")
    met = materialize(seeds(keyed, "tkey", "norm", tiers, wanted).join(looked, "seed").select(F.col("key").alias("tkey"), "needle").distinct(), "seed-matches")
    alike = keyed.join(met.select("tkey").distinct(), "tkey", "left_semi").groupBy("tkey").agg(F.count("*").alias("n"), F.first("norm").alias("norm"))
    return alike.join(met, "tkey").where(F.col("norm").contains(F.col("needle"))).groupBy("needle").agg(F.sum("n").alias("hits"))
