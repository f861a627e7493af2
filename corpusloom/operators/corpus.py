"""Byte budgets, hold-outs and limits over an ordered corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import byte_length, normalize_text
from corpusloom.operators.prefix import with_prefix


def byte_budget(docs: DataFrame, max_bytes: int, order: str = "doc_id") -> DataFrame:
    """Documents in order until their raw bytes reach the budget, the one that crosses it included; one at least."""
    placed = with_prefix(docs.withColumn("bytes", byte_length(F.col("text"))), [order], {"before": F.col("bytes"), "nth": F.lit(1)})
    return placed.where((F.col("before") < max_bytes) | (F.col("nth") == 0)).drop("nth")


def skip_then_sample(docs: DataFrame, skip_bytes: int, take: int, order: str = "doc_id") -> DataFrame:
    """`take` documents after the first skip_bytes (the crossing one is skipped too, and one at least); the corpus's last ones if none is left."""
    placed = with_prefix(docs.withColumn("bytes", byte_length(F.col("text"))), [order], {"before": F.col("bytes"), "nth": F.lit(1)})
    after = placed.where((F.col("nth") > 0) & (F.col("before") >= skip_bytes)).orderBy(order).limit(take)
    last = docs.withColumn("bytes", byte_length(F.col("text"))).orderBy(F.desc(order)).limit(take)
    columns = [*docs.columns, "bytes"]
    fallback = last.select(*columns).join(after.limit(1).select(F.lit(1).alias("_some")), how="left_anti")
    return after.select(*columns).unionByName(fallback)


def tail(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """The last n documents, in order."""
    return docs.orderBy(F.desc(order)).limit(n).orderBy(order)


def head(docs: DataFrame, n: int, order: str = "doc_id") -> DataFrame:
    """The first n documents in order: limit without an order would differ from run to run."""
    return docs.orderBy(order).limit(n)


def min_length(docs: DataFrame, min_chars: int) -> DataFrame:
    """Documents whose normalised text has min_chars code points or more, with that text."""
    norm = docs.withColumn("norm", normalize_text(F.col("text")))
    return norm.where(F.length("norm") >= min_chars)


def ingest(docs: DataFrame, *, min_chars: int, max_bytes: int | None = None, max_docs: int | None = None, done: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """Normalise, drop the short, skip what `done` (order column) has, stop at a number of bytes or documents."""
    kept = min_length(docs, min_chars)
    if done is not None:
        kept = kept.join(done.select(order).distinct(), order, "left_anti")
    placed = with_prefix(kept.withColumn("bytes", byte_length(F.col("norm"))), [order], {"before": F.col("bytes"), "nth": F.lit(1)})
    if max_bytes is not None:
        placed = placed.where(F.col("before") < max_bytes)
    if max_docs is not None:
        placed = placed.where(F.col("nth") < max_docs)
    return placed
