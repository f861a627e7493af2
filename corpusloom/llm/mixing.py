"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key. Within its source, documents are ranged by that key into buckets that all
tasks share evenly, each bucket is sorted on its own, and prefix sums of the bucket totals place every bucket in the
source's order, so that a source with most of the rows needs no task of its own. The running word count then tells
how much of a document falls before its source's budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import free_names, materialize

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, *, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row per source: sid (its place by code point, null last), source_size and target.

    Targets are weight * level, held at cap * size, where the level is the one at which they sum to share * (all
    sizes): what resharing the excess by weight arrives at. With the sources ordered by the level at which each
    reaches its cap, the level is the largest of (budget - caps before) / (weights from here on).
    The table has one row per distinct source, so one task may hold it.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fills_at = Window.orderBy("fills_at", "sid")
    before, onwards = fills_at.rowsBetween(Window.unboundedPreceding, -1), fills_at.rowsBetween(0, Window.unboundedFollowing)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
        .withColumn("target", F.round(F.least("most", F.max("level").over(everything) * F.col("weight")), 6))
        .select("source", "sid", "source_size", "target")
    )


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    docs needs doc_id, text and source; other columns are not looked at. A source's target is met to the word: it
    is taken whole as often as it fits, and the rest comes from the documents with the smallest keys, the last one
    in part. cap bounds repeats, so no document gives more than ceil(cap) times its size.

    Null text: size 0, nothing taken. Null source: a source of its own, last. Null doc_id: the key is of the text.
    Equal keys are ordered by doc_id and size, so repeated rows give the same rows in any order. Empty table:
    no rows. A source without words gets target 0.
    """
    spark = docs.sparkSession
    unnamed = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unnamed.alias("_unnamed")), "mix-sizes")
    targets = materialize(source_targets(sized, weights=weights, share=share, cap=cap), "mix-targets").withColumnRenamed("source", "_source")
    #: As many ranges of each source as keep all tasks of the session's shuffles busy.
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    keyed = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("epochs", whole)
        .withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
        .withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs"), F.col("doc_id"), F.col("_unnamed")).cast("binary")))
        .withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * ranges).cast("int"))
    )
    totals = keyed.groupBy("sid", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("sid", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("offset")), "mix-offsets")
    inside = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, ["sid", "range"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken, the last one cut after the words it gives.

    Rows that repeat a doc_id with as many words are taken alike. Columns are those of docs,
    whatever their names.
    """
    names = docs.columns
    key, size, taken, words, turn = free_names([*names, "size", "taken"], "_id", "_size", "_taken", "_words", "_turn")
    mixed = mix_sources(docs, **options).groupBy("doc_id", "size").agg(F.max("taken").alias(taken))
    mixed = mixed.where(F.col(taken) > 0).select(F.col("doc_id").alias(key), F.col("size").alias(size), taken)
    sized = docs.withColumn(words, word_count(F.col("text")))
    met = sized.join(mixed, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(words) == F.col(size)))
    times = F.ceil(F.col(taken) / F.col(size)).cast("long")
    each = met.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    left = F.least(F.col(size), F.col(taken) - (F.col(turn) - 1) * F.col(size))
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), left.cast("int")), "")
    return each.withColumn("text", F.when(left < F.col(size), start).otherwise(F.col("text"))).select(*names)


def op8(spark, sf_dir: str) -> DataFrame:
    """mix_sources over documents. Nulls, empty texts, ties, repeated rows and empty tables as there; other columns are not looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS unnamed FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((sid - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), targets AS (
  SELECT source, source_size, round(least(most, max(level) OVER () * weight), 6) AS target FROM levels
), keyed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), placed AS (
  SELECT *, round(target)::BIGINT - epochs * source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('|', 'mix', epochs, doc_id, unnamed)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
"""
