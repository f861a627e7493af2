"""Query vectors against all vectors, in blocks that fit in a task."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, qualified, scratch, ship

#: Candidates and queries in a pair of blocks, about; candidates in a block at the least, while blocks are fewer than tasks.
CANDIDATES, QUERIES, LEAST = 16_384, 1_024, 2_048
#: Bytes of vectors in a block at the most.
BLOCK_BYTES = 64 << 20
#: Parts that pairs of blocks are dealt to, at the most; more pairs share parts.
MOST_PARTS = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles), d (its length) and _at (a number of its own) of the rows that take part: neither null nor empty, no null or non-finite component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = clean.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    return materialize(clean.withColumns({"d": F.size("embedding"), "_at": F.monotonically_increasing_id()}), "vectors")


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and the vectors of a group, in ascending vec_id order."""
    ids = table["vec_id"].to_numpy()
    flat = table["embedding"].combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def search(candidates: DataFrame, queries: DataFrame, prepare: Callable, find: Callable, k: int, columns: str, least) -> DataFrame:
    """query_id, rank, vec_id and columns (score first) of each query's k best, higher scores first, ties to the smaller vec_id.

    Both are what usable() gives; a query meets the candidates of its own length. Candidates are dealt to blocks by a
    hash of _at, so that rows that repeat a vec_id are dealt as all others, and a block holds at most about CANDIDATES
    rows or BLOCK_BYTES. A block's index, prepare(ids, vectors), is built once and written to the shared folder; a task
    reads it for each block of queries. find(index, query_ids, query_vectors, thresholds, k) returns columns by name
    with at least each query's k best of the block among those that score at least its threshold. The thresholds are
    the queries' k-th best scores in the first block of their length, `least` where it has fewer. No task holds more
    than a block's index and a block of queries, and k rows a query and block are what leaves it. The driver holds a
    number of blocks for each length.
    """
    spark = candidates.sparkSession
    ship(spark)
    score = columns.split()[0]
    schema = f"query_id long, vec_id long, {columns}"
    # a query comes once: of rows that repeat a vec_id, the smallest vector asks
    asked = materialize(queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("d", F.size("embedding")), "queries")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across, blocks_before = {}, 0
    for d, n in sorted((r["d"], r["count"]) for r in candidates.groupBy("d").count().collect()):
        rows = max(1, min(CANDIDATES, BLOCK_BYTES // (8 * d)))
        # small blocks while there are fewer than tasks
        number = max(1, -(-n // rows), min(parts, -(-n // LEAST)))
        across[d] = (blocks_before, number)
        blocks_before += number
    if not across:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, {columns}")
    down = max(1, -(-asked.count() // QUERIES))
    of_length = lambda i: F.element_at(F.create_map(*[F.lit(x) for d, found in across.items() for x in (d, found[i])]), F.col("d"))
    folder = qualified(spark, scratch(spark, "indexes"))
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)

    def build(group: pa.Table) -> pa.Table:
        block = group["cb"][0].as_py()
        data = pickle.dumps(prepare(*matrix(group)), protocol=5)
        store, place = fs.FileSystem.from_uri(folder)
        draft = f"{place}/.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, f"{place}/{block:06d}.idx")
        return pa.table({"cb": pa.array([block], pa.int32()), "rows": pa.array([group.num_rows], pa.int64())})

    dealt = candidates.select("vec_id", "embedding", (of_length(0) + F.pmod(F.xxhash64("_at"), of_length(1))).cast("int").alias("cb"))
    built = {r.cb for r in dealt.groupBy("cb").applyInArrow(build, "cb int, rows long").select("cb").collect()}
    leading = {d: next(cb for cb in range(first, first + number) if cb in built) for d, (first, number) in across.items()}
    absent = sorted(set(range(blocks_before)) - built)  # blocks that no vector fell into

    def run(group: pa.Table) -> pa.Table:
        index = load(folder, group["cb"][0].as_py())
        order = np.argsort(group["vec_id"].to_numpy(), kind="stable")
        ids, vectors = matrix(group)
        return pa.table(find(index, ids, vectors, group["least"].to_numpy()[order], k))

    def against(asking: DataFrame, first: bool) -> DataFrame:
        met = asking.where(F.col("d").isin(sorted(across))).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit("qb")), F.lit(down)).cast("int"))
        lead = F.element_at(F.create_map(*[F.lit(x) for item in leading.items() for x in item]), F.col("d"))
        if first:
            spread = met.withColumn("cb", lead)
        else:
            spread = met.withColumn("cb", F.explode(F.sequence(of_length(0), of_length(0) + of_length(1) - 1))).where((F.col("cb") != lead) & ~F.col("cb").isin(absent))
        # few bytes make much work: a stated number of parts, which the planner does not merge by their bytes
        pairs = (len(leading) if first else len(built)) * down
        return spread.drop("d").repartition(max(parts, min(pairs, MOST_PARTS)), "cb", "qb").groupBy("cb", "qb").applyInArrow(run, schema)

    order = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = materialize(best(against(asked.withColumn("least", F.lit(least)), True)), "first-block")
    if len(built) > len(leading):
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col(score).alias("least"))
        asking = asked.join(kth, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(least)))
        found = best(found.drop("rank").unionByName(against(asking, False)))
    names = [c.split()[0] for c in columns.split(", ")]
    return found.select("query_id", "rank", "vec_id", *names)


@lru_cache(maxsize=1)
def load(folder: str, block: int):
    """A block's index; a worker keeps the last one."""
    store, place = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{place}/{block:06d}.idx") as f:
        return pickle.loads(f.read())


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]
