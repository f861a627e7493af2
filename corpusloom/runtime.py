"""Session plumbing that every part of the library shares."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, str] = {}
#: Paths that scratch() gives out while passing() is open, innermost last.
_OPEN: list[list[str]] = []
#: Bits of a sieve, a row of 32,768 of them each (Spark's bitmap functions): 4 MiB at most, however many keys set them.
SIEVE_BITS = 1 << 25
#: Bytes that one Arrow batch of rows may take on its way to a Python worker; bounds what a worker holds of long texts.
BATCH_BYTES = 16 << 20
#: Estimates from here on stand for sizes that the optimizer does not know (a petabyte).
UNKNOWN = 1 << 50


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow UDFs import it there."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(batch, "1g"))) > BATCH_BYTES:
        spark.conf.set(batch, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    archive = os.path.join(folder, "corpusloom_pkg.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, Path(package.name) / path.relative_to(package))
    spark.sparkContext.addPyFile(archive)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(app)


def qualified(spark: SparkSession, path: str) -> str:
    """path with the scheme of the file system that Spark finds it in; one that pyarrow can open too."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", full))


def _file(path: str):
    """A path and its file system, as Spark sees them."""
    spark = SparkSession.active()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, spark._jvm


def write_file(path: str, data: bytes) -> None:
    """Write a small file in any file system that Spark knows; it is renamed from a draft when it is whole."""
    system, where, jvm = _file(path)
    draft = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = system.create(draft, True)
    try:
        out.write(data)
    finally:
        out.close()
    system.delete(where, False)
    if not system.rename(draft, where):
        raise OSError(f"cannot write {path}")


def read_file(path: str) -> bytes:
    """The bytes of a small file in any file system that Spark knows; OSError if there is none or it cannot be read."""
    system, where, jvm = _file(path)
    if not system.exists(where):
        raise FileNotFoundError(path)
    stream = system.open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    except Py4JJavaError as error:
        raise OSError(f"cannot read {path}") from error
    finally:
        stream.close()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which the driver and all executors see; deleted when the driver ends.

    Where the setting is missing, a temporary folder serves a local master (tests); on a cluster that is an error, as
    executors would each write to their own disk.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="corpusloom-shared-")
            atexit.register(shutil.rmtree, root, True)
            root = f"file://{root}"
        _SCRATCH[app] = f"{root.rstrip('/')}/corpusloom-{uuid.uuid4().hex[:12]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH[app])
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)
    return _SCRATCH[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for opened in _OPEN[-1:]:
        opened.append(path)
    return path


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is deleted at the end, and Spark is let delete the shuffles; whatever is needed later is written outside."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        release(spark)


def materialize_last(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """materialize() what make() returns, and delete everything that make() wrote on the way."""
    path = scratch(spark, name)
    with passing(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder as Parquet and read it back: cuts the lineage and gives the planner true sizes."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sifted(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """df (with a whole number `key`) in two: the rows whose key is perhaps among keys (a table with that column), and those whose key is not for certain, null keys among them.

    Each key sets one of SIEVE_BITS bits, which all tasks get, so that of a table of texts only a few are shuffled to
    be joined exactly; what keys there are too many for the bits lets through more rows and changes no result.
    """
    bit, sector, bits = free_names(df.columns, "_bit", "_sector", "_bits")
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SIEVE_BITS)) + 1
    set_ = keys.where(F.col(key).isNotNull()).select(place(key).alias(bit))
    sieve = set_.groupBy(F.bitmap_bucket_number(bit).alias(sector)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias(bits))
    sieve = materialize(sieve, "sieve")
    marked = df.withColumn(bit, place(key)).withColumn(sector, F.bitmap_bucket_number(bit)).join(F.broadcast(sieve), sector, "left")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return marked.where(there).select(*df.columns), marked.where(~there).select(*df.columns)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as make it differ from all taken ones (Spark does not tell upper from lower case)."""
    lower, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in lower:
            name = f"_{name}"
        lower.add(name.lower())
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so once the driver's JVM has collected what stood for them, which a driver with little to do may put off for long."""
    spark.sparkContext._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size: for a table on disk, the bytes of its files. No job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, each: int) -> int:
    """Parts to deal df into so that one is about `each` bytes on disk; at least the session's number of shuffle partitions, which is the answer where the size is not known."""
    size = plan_bytes(df)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each) if size < UNKNOWN else 0)
