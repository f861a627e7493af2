"""Exact deduplication by content hash and the deterministic split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.hashing import md5_hash, split_of
from corpusloom.functions.text import normalize_text
from corpusloom.runtime import free_names


@F.pandas_udf(StringType())
def normalize_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC by Python's tables, for a Spark that lacks the composer that functions.text.nfc calls."""
    import unicodedata

    for batch in batches:
        yield batch.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def keep_first(docs: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """The row of smallest `order` of each key. Only (key, order) is aggregated, before and after the shuffle, so a key with very many rows is one row a task; the texts are then picked by a semi join.

    Rows without `order` come after all others: one of them stays for each key that no other row has. Rows that share
    an `order` stay or go together.
    """
    (name,) = free_names(docs.columns, "_key")
    first = docs.where(F.col(order).isNotNull()).select(key.alias(name), F.col(order)).groupBy(name).agg(F.min(order).alias(order))
    unplaced = docs.where(F.col(order).isNull()).withColumn(name, key)
    alone = unplaced.join(first.select(name), name, "left_anti").dropDuplicates([name]).select(*docs.columns)
    return docs.join(first.select(order).distinct(), order, "left_semi").select(*docs.columns).unionByName(alone)


def exact_dedup(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """First document of each normalised text."""
    return keep_first(docs, md5_hash(normalize_text(F.coalesce("text", F.lit("")))), order)


def duplicates(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """What exact_dedup drops."""
    return docs.select(order).exceptAll(exact_dedup(docs, order).select(order))


def split_documents(docs: DataFrame, val_ratio: float, digest: Column | None = None) -> DataFrame:
    """docs with split, a function of their content alone."""
    digest = md5_hash(normalize_text(F.coalesce("text", F.lit("")))) if digest is None else digest
    return docs.withColumn("split", split_of(digest, val_ratio))


def pack_stats(docs: DataFrame, val_ratio: float, n_tokens: Column, order: str = "doc_id") -> DataFrame:
    """One row: documents in, duplicates, kept, tokens of the two splits and in all (each document's begin and end marks included)."""
    kept = split_documents(exact_dedup(docs, order), val_ratio).withColumn("n", n_tokens + 2)
    figures = kept.agg(
        F.count("*").alias("n_kept"),
        F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("n"))), F.lit(0)).cast("long").alias("train_tokens"),
        F.coalesce(F.sum(F.when(F.col("split") == "val", F.col("n"))), F.lit(0)).cast("long").alias("val_tokens"),
    )
    read = docs.agg(F.count("*").alias("n_in"))
    return figures.crossJoin(read).select("n_in", (F.col("n_in") - F.col("n_kept")).alias("n_duplicates"), "n_kept", "train_tokens", "val_tokens", (F.col("train_tokens") + F.col("val_tokens")).alias("n_tokens"))
