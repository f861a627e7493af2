"""JSON Lines scans and sinks, ingest inventory, shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.config import CORPUS, WHITE_SPACE
from corpusloom.functions.text import byte_length, normalize_text
from corpusloom.operators.greedy import shard_of_rows
from corpusloom.runtime import free_names, materialize

#: File names that are sent to all tasks; of more files, the names are joined.
MOST_FILES = 100_000


def string_field(line: Column, field: str) -> tuple[Column, Column, Column]:
    """Of a line: whether it is JSON, whether it is an object, and the field's value if that is a string.

    Parsed as a variant: parsing to a string column would turn numbers into text.
    """
    parsed = F.try_parse_json(line)
    kind = F.schema_of_variant(parsed)
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, f"$.{field}", "string"))
    return parsed.isNotNull(), F.startswith(kind, F.lit("OBJECT")), text


def parse_lenient(lines: DataFrame, field: str = "text") -> DataFrame:
    """lines (value, and any order columns) with text: blank, broken and textless lines are left out; a value that is no object is an error."""
    valid, is_object, text = string_field(F.col("value"), field)
    kept = lines.where(F.btrim("value", F.lit(WHITE_SPACE)) != "").withColumn("_valid", valid).where("_valid")
    checked = F.when(is_object, text).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80))))
    return kept.withColumn("text", checked).where("text <> ''").drop("value", "_valid")


def violations(lines: DataFrame, field: str = "text") -> DataFrame:
    """line_no, fault of the lines (line_no, value) that a strict scan refuses."""
    valid, is_object, text = string_field(F.col("value"), field)
    fault = F.when(~valid, "malformed JSON").when(~is_object, "not an object").when(text.isNull(), "missing or not a string").when(F.btrim(text, F.lit(WHITE_SPACE)) == "", "blank")
    return lines.where(F.btrim("value", F.lit(WHITE_SPACE)) != "").select("line_no", fault.alias("fault")).where("fault is not null")


def parse_strict(lines: DataFrame, field: str = "text") -> DataFrame:
    """lines (line_no, value) with text; raises with the first refused line's number."""
    first = violations(lines, field).orderBy("line_no").first()
    if first:
        raise ValueError(f"line {first.line_no}: {first.fault}")
    return lines.where(F.btrim("value", F.lit(WHITE_SPACE)) != "").withColumn("text", string_field(F.col("value"), field)[2]).drop("value")


def read_corpus(spark: SparkSession, path: str, field: str = "text", prefix: str = "") -> DataFrame:
    """file, text of all JSON Lines files of a folder, or of those whose name begins with a source's prefix; order by file, then by the line's place in it (sources keep an order column where that matters).

    file_no counts the files by name, from 0: the order in which a corpus is read.
    """
    start = re.sub(r"([\\*?\[\]{}])", r"\\\1", prefix)
    lines = spark.read.text(path, pathGlobFilter=f"{start}*.jsonl").withColumn("file", F.col("_metadata.file_name"))
    names = lines.select("file").distinct()  # a row a file
    numbered = names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("file_no"))
    return parse_lenient(lines, field).join(F.broadcast(numbered), "file") if len(lines.inputFiles()) <= MOST_FILES else parse_lenient(lines, field).join(numbered, "file")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1), value of a file that a strict scan reads, or of a folder's files, taken one after another by name.

    A large file is read in splits, a task each. The lines of each split are counted first, a row a split; the counts
    before a split and a line's place in it make its number. Lines end as Python's text files end them: \\n, \\r\\n or \\r.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # a row a split: of 10 TB in splits of 128 MB, 80,000
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialize(splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "line-splits")
    return lines.join(F.broadcast(placed), ["file", "split"]).select((F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def write_jsonl(docs: DataFrame, path: str) -> DataFrame:
    """Write normalised, non-empty texts; returns one row: docs, text_bytes."""
    norm = docs.select(normalize_text(F.col("text")).alias("text")).where("text <> ''")
    norm.write.mode("overwrite").json(path)
    written = norm.sparkSession.read.schema("text string").json(path)
    return written.agg(F.count("*").alias("docs"), F.coalesce(F.sum(byte_length(F.col("text"))), F.lit(0)).alias("text_bytes"))


def inventory(rows: DataFrame) -> DataFrame:
    """source, n_docs, n_bytes, next_shard of rows (file, text): what has been ingested and where to go on. Files without a numeric shard are ignored."""
    name = F.regexp_extract("file", r"^(.+)_(\d+)\.jsonl$", 1)
    number = F.regexp_extract("file", r"^(.+)_(\d+)\.jsonl$", 2)
    placed = rows.where(number != "").select(name.alias("source"), number.cast("int").alias("shard"), byte_length(F.col("text")).alias("b"))
    return placed.groupBy("source").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("b"), F.lit(0)).alias("n_bytes"), (F.max("shard") + 1).cast("long").alias("next_shard"))


def shard_numbers(docs: DataFrame, by: str, order: str, first: int = 0, shard_bytes: int = CORPUS.shard_bytes) -> DataFrame:
    """docs with shard: a shard closes once its bytes reach shard_bytes, and counting starts anew.

    The fold is taken as jumps over prefix sums (operators/greedy.py), so that a source of very many rows is many tasks;
    only (order, bytes) are looked at. order must be a number. Null sources are a source, null orders come first; rows
    that share both are one document to the fold and stay together.
    """
    key, place = free_names([*docs.columns, "shard"], "_by", "_order")
    sizes = docs.groupBy(F.col(by).alias("g"), F.col(order).alias("o")).agg(F.sum(byte_length(F.coalesce("text", F.lit("")))).alias("b"))
    placed = shard_of_rows(sizes, first=first, shard_bytes=shard_bytes).select(F.col("g").alias(key), F.col("o").alias(place), "shard")
    same = F.col(by).eqNullSafe(F.col(key)) & F.col(order).eqNullSafe(F.col(place))
    return docs.join(placed, same).drop(key, place)


def write_shards(docs: DataFrame, path: str, by: str = "source") -> None:
    """One folder for each source and shard; rows need `shard`."""
    docs.select(by, "shard", "text").write.mode("append").partitionBy(by, "shard").json(path)


def file_fingerprints(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """path, length, digest (BLAKE2b-128 of the bytes) of files; with length, of files of that size only: the others are not read. A file is read by one task, so large sources are kept as folders of many files."""
    import hashlib

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: hashlib.blake2b(b, digest_size=16).hexdigest())

    files = spark.read.format("binaryFile").load(path)
    files = files if length is None else files.where(F.col("length") == length)
    return files.select("path", "length", digest("content").alias("digest"))


def copies_of(spark: SparkSession, path: str, file: str) -> DataFrame:
    """path of the files under path that have the same bytes as file; only those of its size are read."""
    wanted = file_fingerprints(spark, file).first()
    return file_fingerprints(spark, path, wanted.length).where(F.col("digest") == wanted.digest).select("path")


def held_out(docs: DataFrame, path: str, source: str) -> dict:
    """Write a held-out set and prove that neither its count nor its source changed meanwhile: docs, text_bytes, source (the digest of each of its files) and folders (those that hold them)."""
    spark = docs.sparkSession
    before = file_fingerprints(spark, source).orderBy("path").collect()
    written = write_jsonl(docs, path).first()
    if file_fingerprints(spark, source).orderBy("path").collect() != before:
        raise ValueError("the source changed while the held-out set was written")
    again = read_corpus_json(spark, path).count()
    if again != written.docs:
        raise ValueError(f"{written.docs} texts written, {again} read back")
    return {"docs": written.docs, "text_bytes": written.text_bytes, "source": [r.digest for r in before], "folders": sorted({r.path.rpartition("/")[0] for r in before})}


def read_corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """text of what write_jsonl wrote."""
    return spark.read.schema("text string").json(path)
