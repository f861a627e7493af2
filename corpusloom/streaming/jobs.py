"""Structured Streaming jobs: resumable ingest, first-seen dedup, incremental decoding, progress."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.hashing import md5_hash
from corpusloom.functions.text import normalize_text


class Progress(StreamingQueryListener):
    """Reports (run, rows read so far) of each query whenever another `every` rows have been read; to be added to spark.streams."""

    def __init__(self, every: int, report: Callable[[str, int], None]):
        self.every, self.report, self.rows = every, report, Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run, new = str(event.progress.runId), event.progress.numInputRows
        self.rows[run] += new
        if self.rows[run] // self.every > (self.rows[run] - new) // self.every:
            self.report(run, self.rows[run])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.pop(str(event.runId), None)


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, *, min_chars: int, files_per_batch: int = 64) -> StreamingQuery:
    """Append normalised documents of min_chars or more to a Parquet folder, once each: the checkpoint's file log takes the place of counting what was accepted."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    kept = docs.withColumn("text", normalize_text(F.col("text"))).where(F.length("text") >= min_chars)
    return kept.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(docs: DataFrame, event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """A stream's documents whose normalised text has not come before; with event_time and horizon, within that time only, which bounds the state."""
    hashed = docs.withColumn("h", md5_hash(normalize_text(F.coalesce("text", F.lit("")))))
    if event_time and horizon:
        return hashed.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["h"])
    return hashed.dropDuplicates(["h"])


#: Settings of a stream whose state may exceed the executors' heaps: RocksDB holds it on their disks, and a checkpoint writes what has changed since the last one.
LARGE_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def keep_first_seen(docs: DataFrame, sink: str, checkpoint: str, event_time: str | None = None, horizon: str | None = None) -> StreamingQuery:
    """Append the first document of each normalised text of a stream to a Parquet folder, over all runs from this checkpoint.

    The hashes seen are kept by RocksDB, so that their number is bounded by disk, not by memory; a restarted run goes
    on from the checkpoint, and no text is lost or written twice. The session's own settings are put back.
    """
    conf, before = docs.sparkSession.conf, {}
    for name, value in LARGE_STATE.items():
        before[name] = conf.get(name, None)
        conf.set(name, value)
    try:
        return first_seen(docs, event_time, horizon).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # a started query has its own copy of the settings
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def stable_text(held: bytes, new: bytes) -> tuple[str, bytes]:
    """Text that is certain once new bytes follow the held ones, and the bytes of a character that may still grow."""
    data = held + new
    for keep in range(min(3, len(data)) + 1):
        head, rest = data[: len(data) - keep], data[len(data) - keep :]
        lead = rest[:1]
        need = 2 if b"\xc2" <= lead < b"\xe0" else 3 if b"\xe0" <= lead < b"\xf0" else 4 if b"\xf0" <= lead <= b"\xf4" else 0
        if keep and len(rest) < need and all(0x80 <= b < 0xC0 for b in rest[1:]):
            return head.decode("utf-8", "replace"), rest
    return data.decode("utf-8", "replace"), b""


def incremental_decode(tokens: DataFrame) -> DataFrame:
    """A stream of (conv_id, seq, piece bytes, last) as (conv_id, seq, delta): what each piece makes certain. The state is at most three bytes a conversation."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = bytes(state.get[0]) if state.exists else b""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, piece, last in zip(rows["seq"], rows["piece"], rows["last"], strict=True):
            delta, held = stable_text(held, bytes(piece))
            if last:
                delta, held = delta + held.decode("utf-8", "replace"), b""
            out.append((key[0], seq, delta))
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["conv_id", "seq", "delta"])

    return tokens.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, seq long, delta string", "held binary", "append", GroupStateTimeout.NoTimeout)


def latest_snapshot(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of progress rows (run, step, ...) to path/history and keep the newest row of each run under path/latest, for read_latest.

    Each batch has folders of its own, which a batch that is tried again writes anew; the newest rows come from those
    of the batch before and the batch's own, not from the whole history.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        rows.write.mode("overwrite").parquet(f"{path}/history/batch={number}")
        before = _batches(rows.sparkSession, f"{path}/latest")
        known = [b for b in before if b < number]
        held = rows.unionByName(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/latest/batch={max(known)}")) if known else rows
        others = [c for c in rows.columns if c != "run"]
        newest = held.groupBy("run").agg(F.max_by(F.struct(*others), "step").alias("r")).select("run", "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/latest/batch={number}")
        rows.unpersist()
        for old in sorted(known)[:-1]:  # the last one may still be read
            _path(rows.sparkSession, f"{path}/latest/batch={old}", delete=True)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str, *, delete: bool = False):
    """The file system and path of a folder, which goes with delete."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        system.delete(where, True)
    return system, where


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are whole under path."""
    system, where = _path(spark, path)
    if not system.exists(where):
        return []
    folders = [f.getPath().toString() for f in system.listStatus(where)]
    return [int(f.rpartition("=")[2]) for f in folders if "batch=" in f and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS"))]


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each run that latest_snapshot keeps under path."""
    return spark.read.parquet(f"{path}/latest/batch={max(_batches(spark, f'{path}/latest'))}")
