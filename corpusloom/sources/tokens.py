"""Token tables, one row a window with its split, and raw token files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusloom.operators.packing import check_range
from corpusloom.runtime import materialize, parts_for, qualified, ship

SCHEMA = "split string, window_id long, x array<int>, y array<int>"


def write_split(windows: DataFrame, path: str, split: str, largest: int) -> None:
    """Append the windows (window_id, x, y) of a split; an id outside 0..largest fails the job before anything is committed."""
    checked = windows.select(F.lit(split).alias("split"), "window_id", check_range(F.col("x"), largest).alias("x"), check_range(F.col("y"), largest).alias("y"))
    checked.write.mode("append").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The windows of a split; none where there is no such table."""
    try:
        return spark.read.schema(SCHEMA).parquet(path).where(F.col("split") == split)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def require_windows(windows: DataFrame) -> DataFrame:
    """windows, or an error where there is not one."""
    if windows.isEmpty():
        raise ValueError("not enough tokens for one window")
    return windows


#: Bytes of the table on disk for which there is one raw file.
FILE_BYTES = 128 << 20


def write_raw(docs: DataFrame, path: str, largest: int, order: str = "doc_id") -> DataFrame:
    """Write docs (order, ids) as raw files of little-endian unsigned 16-bit ids, 32-bit where `largest` needs it, in ascending order; returns file, width, start, n of each.

    One file a range of documents, tokens-00000.bin first. A file gets its name when it is whole, so that a task that
    runs twice leaves one. An id outside 0..largest fails the job before its file has a name. Null ids are no ids.
    """
    spark = docs.sparkSession
    ship(spark)
    path = qualified(spark, path)
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place, recursive=True)
    dtype = np.dtype("<u2" if largest < 1 << 16 else "<u4")
    checked = docs.select(order, check_range(F.coalesce("ids", F.array().cast("array<int>")), largest).alias("ids"))
    placed = checked.repartitionByRange(parts_for(docs, FILE_BYTES), F.col(order).asc_nulls_first()).sortWithinPartitions(F.col(order).asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, n = TaskContext.get().partitionId(), 0
        store, folder = fs.FileSystem.from_uri(path)
        draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as out:
            for batch in batches:
                ids = batch["ids"].flatten().to_numpy(zero_copy_only=False).astype(dtype)
                out.write(ids.tobytes())
                n += len(ids)
        name = f"tokens-{number:05d}.bin"
        store.move(draft, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([dtype.itemsize], pa.int32()), pa.array([n], pa.int64())], ["file", "width", "n"])

    files = materialize(placed.select("ids").mapInArrow(run, "file string, width int, n long"), "raw-files").orderBy("file").collect()  # a row a file
    start, rows = 0, []
    for f in files:
        rows.append((f.file, f.width, start, f.n))
        start += f.n
    return spark.createDataFrame(rows, "file string, width int, start long, n long")


def read_raw(spark: SparkSession, path: str, width: int, chunk: int = 1 << 16) -> DataFrame:
    """file, chunk_no, ids of raw files, `chunk` ids a row."""
    ship(spark)
    path = qualified(spark, path)
    store, place = fs.FileSystem.from_uri(path)
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(place)) if f.base_name.endswith(".bin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch["file"].to_pylist():
                with store.open_input_stream(f"{folder}/{name}") as f:
                    number = 0
                    while data := f.read(chunk * width):
                        ids = pa.array([np.frombuffer(data, f"<u{width}").astype(np.int32)], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), ids], ["file", "chunk_no", "ids"])
                        number += 1

    listed = spark.createDataFrame([(n,) for n in names], "file string")
    return listed.repartition(max(1, len(names))).mapInArrow(run, "file string, chunk_no long, ids array<int>")
