import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import catalogue
from corpusloom.runtime import shared_dir
from corpusloom.streaming import jobs


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_ingest_resumes(spark, tmp_path):
    source, sink, log = (f"file://{tmp_path}/{n}" for n in ("in", "out", "log"))
    schema = "doc_id long, text string"
    for first in (0, 10):
        spark.createDataFrame([(first + i, "  " + "x" * (5 + i)) for i in range(5)], schema).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest(spark, source, schema, sink, log, min_chars=7).awaitTermination()
        assert spark.read.parquet(sink).count() == (3 if first == 0 else 6)
    jobs.ingest(spark, source, schema, sink, log, min_chars=7).awaitTermination()
    assert spark.read.parquet(sink).count() == 6


def test_progress(spark, tmp_path):
    source, sink, log = (f"file://{tmp_path}/{n}" for n in ("in", "out", "log"))
    for first in range(0, 20, 4):
        spark.createDataFrame([(first + i, "text") for i in range(4)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
    seen = []
    progress = jobs.Progress(10, lambda run, rows: seen.append((run, rows)))
    spark.streams.addListener(progress)
    try:
        q = jobs.ingest(spark, source, "doc_id long, text string", sink, log, min_chars=1, files_per_batch=1)
        q.awaitTermination()
        until = time.monotonic() + 20
        while len(seen) < 2 and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert seen == [(str(q.runId), 12), (str(q.runId), 20)]


def test_first_seen(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    for i in range(2):
        spark.createDataFrame([(1, "một"), (2, "hai"), (3 + i, f"{i}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(path)
    assert sorted(r.text for r in run(jobs.first_seen(stream), "first_seen").collect()) == ["0", "1", "hai", "một"]


def test_first_seen_goes_on_after_a_restart(spark, tmp_path):
    """Runs one after another from one checkpoint: each text once, by RocksDB's files, and the session as it was."""
    source, sink, log = (f"file://{tmp_path}/{n}" for n in ("in", "out", "log"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    for first in (0, 300, 500):
        spark.createDataFrame([(first + i, f"  text {(first + i) % 450}") for i in range(400)], "doc_id long, text string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 2).parquet(source)
        jobs.keep_first_seen(stream, sink, log).awaitTermination()
    assert spark.conf.get(setting) == before
    kept = [r.text.strip() for r in spark.read.parquet(sink).collect()]
    assert sorted(kept) == sorted(f"text {i}" for i in range(450))
    files = [f.name for f in (tmp_path / "log" / "state").rglob("*") if f.is_file()]
    assert any(f.endswith(".changelog") for f in files) and not any(f.endswith(".delta") for f in files)


@pytest.mark.parametrize("name, batches", [("stream_first_seen", 3), ("stream_latest_snapshot", 3), ("stream_ingest", 2), ("stream_pages", 7)])
def test_sources_of_streams_are_cut_by_size(spark, monkeypatch, name, batches):
    """A larger table is more files, not larger ones; the rows are the same."""
    root, sf_dir = Path(shared_dir(spark).removeprefix("file:")), "/root/testdata/sf0.001"
    found = []
    for size in (catalogue.FILE_BYTES, 1_000):
        monkeypatch.setattr(catalogue, "FILE_BYTES", size)
        there = set(root.iterdir())
        rows = sorted(map(repr, catalogue.QUERIES[name](spark, sf_dir).collect()))
        (made,) = [p for p in set(root.iterdir()) - there if p.name.startswith("stream-")]
        found.append((rows, len(list((made / "in").glob("*.parquet")))))
    assert found[0][0] == found[1][0] and found[0][1] == batches and found[1][1] > 2 * batches


def test_stable_text():
    for text in ("plain", "é", "漢字", "😀x", "á"):
        data, held, out = text.encode(), b"", ""
        for b in data:
            delta, held = jobs.stable_text(held, bytes([b]))
            out += delta
        assert out == text and held == b""
    assert jobs.stable_text(b"", b"\xff") == ("�", b"")


def test_incremental_decode(spark, tmp_path):
    path = f"file://{tmp_path}/pieces"
    schema = "conv_id long, seq long, piece binary, last boolean"
    data = "aé😀漢".encode()
    for i, b in enumerate(data):
        spark.createDataFrame([(1, i, bytes([b]), i == len(data) - 1), (2, i, b"x", False)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    got = run(jobs.incremental_decode(stream), "decoded").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("d")).collect()
    texts = {r.conv_id: "".join(x.delta for x in r.d) for r in got}
    assert texts == {1: "aé😀漢", 2: "x" * len(data)}


def test_latest_snapshot(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 7, 0.1)], "run string, step long, loss double").write.parquet(path)
    stream = spark.readStream.schema("run string, step long, loss double").parquet(path)
    jobs.latest_snapshot(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination()
    assert {(r.run, r.step) for r in jobs.read_latest(spark, f"file://{tmp_path}/log").collect()} == {("a", 2), ("b", 7)}
    for step in (1, 9):
        spark.createDataFrame([("b", step, 0.2)], "run string, step long, loss double").write.mode("append").parquet(path)
        jobs.latest_snapshot(stream, f"file://{tmp_path}/log", f"file://{tmp_path}/cp").awaitTermination()
    assert {(r.run, r.step) for r in jobs.read_latest(spark, f"file://{tmp_path}/log").collect()} == {("a", 2), ("b", 9)}
    assert spark.read.parquet(f"file://{tmp_path}/log/history").count() == 5
    assert len(list((tmp_path / "log" / "latest").iterdir())) == 2
