"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.trie import UnionFind
from corpusloom.runtime import materialize, ship

#: Edges that are left from which one task finishes: less than a megabyte, whatever the graph was.
FEW_EDGES = 50_000


def finish(edges: DataFrame) -> DataFrame:
    """id, component of few edges, by union-find in one task."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([b["u"].to_numpy(), b["v"].to_numpy()], 1) for b in batches]
        ids, at = np.unique(np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), return_inverse=True)
        union = UnionFind(len(ids))
        for a, b in at.reshape(-1, 2).tolist():
            union.union(a, b)
        roots = np.array([union.find(i) for i in range(len(ids))], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[roots])], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame) -> DataFrame:
    """id, component for each end of edges (u, v); component is the smallest id that it reaches.

    Each round maps every node to its smallest neighbour or itself and rewrites the edges by that map, which keeps
    what is connected so and at least halves the nodes that still have edges; no task gathers a node's neighbours,
    as only their minimum is taken. Once no more than FEW_EDGES are left, one task finishes. Null ends must not occur.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    placed = None
    while edges.count() > FEW_EDGES:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("component")), "step")
        placed = step if placed is None else moved(placed, step)
        a, b = step.select(F.col("id").alias("u"), F.col("component").alias("x")), step.select(F.col("id").alias("v"), F.col("component").alias("y"))
        left = edges.join(a, "u").join(b, "v").where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        edges = materialize(left.distinct(), "edges")
    last = materialize(finish(edges), "placed")
    return last if placed is None else moved(placed, last)


def moved(placed: DataFrame, step: DataFrame) -> DataFrame:
    """placed with its components moved to where step maps them."""
    to = step.select(F.col("id").alias("component"), F.col("component").alias("to"))
    return materialize(placed.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "placed")
