"""The paged streaming source and line numbers of files that are read in splits."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import jsonl
from corpusloom.streaming import pages


def run(spark, path):
    stream = pages.read_pages(spark, f"file://{path}/in")
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.page, r.row, r.text) for r in spark.read.schema(pages.SCHEMA).parquet(f"{path}/out").collect())


def test_a_resumed_run_reads_no_page_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page = lambda name, lines: (tmp_path / "in" / name).write_text("\n".join(lines))
    page("0001.jsonl", ['{"text": "one"}', "broken", '{"text": 7}', '{"text": "zwei é"}'])
    page(".hidden.jsonl", ['{"text": "no"}'])
    page("notes.txt", ["no"])
    first = [("0001.jsonl", 0, "one"), ("0001.jsonl", 1, None), ("0001.jsonl", 2, None), ("0001.jsonl", 3, "zwei é")]
    assert run(spark, tmp_path) == first
    assert run(spark, tmp_path) == first  # nothing new
    spark.createDataFrame([("p",), (None,)], "text string").coalesce(1).write.parquet(f"file://{tmp_path}/made")
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "in" / "0003.parquet")
    page("0002.jsonl", [json.dumps({"text": f"t{i}"}) for i in range(3_000)])
    page("0000.jsonl", ['{"text": "came too late"}'])  # before the last page read
    got = run(spark, tmp_path)
    assert got == first + [("0002.jsonl", i, f"t{i}") for i in range(3_000)] + [("0003.parquet", 0, "p"), ("0003.parquet", 1, None)]


def test_pages_of_an_empty_folder(spark, tmp_path):
    assert run(spark, tmp_path) == []


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_numbers_over_splits(spark, tmp_path, end):
    """A file of many splits: every line's number, blank lines and the first bad line's included."""
    lines = [json.dumps({"text": "x" * (i % 37) + "é"}) if i % 11 else "" for i in range(9_000)]
    lines[7_654] = '{"text": "cut'
    (tmp_path / "held.jsonl").write_text(end.join(lines) + end, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9001")
    try:
        got = jsonl.numbered_lines(spark, f"file://{tmp_path}/held.jsonl")
        assert got.rdd.getNumPartitions() > 10
        assert sorted((r.line_no, r.value) for r in got.collect()) == list(enumerate(lines, 1))
        with pytest.raises(ValueError, match="line 7655: malformed"):
            jsonl.parse_strict(got)
        (tmp_path / "more").mkdir()
        for name, part in (("a", lines[:101]), ("b", []), ("c", lines[101:300])):
            (tmp_path / "more" / name).write_text(end.join(part), newline="")
        folder = jsonl.numbered_lines(spark, f"file://{tmp_path}/more")
        assert sorted((r.line_no, r.value) for r in folder.collect()) == list(enumerate(lines[:300], 1))
        assert jsonl.violations(folder.where(F.col("line_no") > 300)).collect() == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
