"""A streaming source of paged documents that a run can stop and go on reading.

Pages are files of a folder, taken in the order of their names; new ones may come while a run goes on, with later
names. An offset is the name of the last page read, so a checkpoint says where to go on, whatever has been added since,
and no page is read twice. A page is a partition: JSON Lines or Parquet, read in record batches.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from corpusloom.runtime import qualified, ship

SCHEMA = "page string, row long, text string"


class Page(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class PageReader(DataSourceStreamReader):
    """Options: path (a URI), field (the text's name in a page), most (pages of one batch)."""

    def __init__(self, options: dict):
        self.path, self.field, self.most = options["path"], options.get("field", "text"), int(options.get("most", 64))

    def pages(self, after: str) -> list[str]:
        store, folder = fs.FileSystem.from_uri(self.path)
        listed = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in listed if f.is_file and f.base_name > after and f.base_name[0] not in "._" and f.base_name.endswith((".jsonl", ".parquet")))

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.pages(""), default="")}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(name) for name in self.pages(start["last"]) if name <= end["last"]]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(self.path)
        row = 0
        with store.open_input_file(f"{folder}/{partition.name}") as file:
            texts = self.lines(file) if partition.name.endswith(".jsonl") else (b.column(0).to_pylist() for b in pq.ParquetFile(file).iter_batches(1_024, columns=[self.field]))
            for held in texts:
                n = len(held)
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n, pa.string()), pa.array(range(row, row + n), pa.int64()), pa.array(held, pa.string())], ["page", "row", "text"])
                row += n

    def lines(self, file) -> Iterator[list[str | None]]:
        """The texts of JSON Lines, a thousand at a time; null for a line that is broken or has no text, so that rows keep their numbers."""
        held: list[str | None] = []
        for line in io.TextIOWrapper(file, encoding="utf-8", errors="replace", newline="\n"):
            try:
                value = json.loads(line)
            except ValueError:
                value = None
            text = value.get(self.field) if isinstance(value, dict) else None
            held.append(text if isinstance(text, str) else None)
            if len(held) == 1_024:
                yield held
                held = []
        if held:
            yield held


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_pages"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, *, field: str = "text") -> DataFrame:
    """A stream of page, row, text of the pages under path. Null texts are lines without one."""
    ship(spark)
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("corpus_pages").option("path", qualified(spark, path)).option("field", field).load()


def gather(spark: SparkSession, made: str, path: str, by: str) -> int:
    """Move the files of a table that was written partitioned by a number into path as pages, named by that number and their place; returns how many. Names are listed, no rows."""
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    system = source.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    n = 0
    for folder in system.listStatus(source):
        name = folder.getPath().getName()
        if not name.startswith(f"{by}="):
            continue
        files = sorted(f.getPath().toString() for f in system.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet"))
        for i, file in enumerate(files):
            page = jvm.org.apache.hadoop.fs.Path(target, f"{by}-{int(name.partition('=')[2]):08d}-{i:05d}.parquet")
            if not system.rename(jvm.org.apache.hadoop.fs.Path(file), page):
                raise OSError(f"cannot move {file}")
            n += 1
    return n
