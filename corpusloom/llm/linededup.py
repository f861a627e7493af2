"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

The index is a folder. A line key belongs to a shard by its hash.

* `filters` holds a cuckoo filter for each shard, over the keys that at least one document holds.
* `references` is the exact table behind them: a row (shard, doc_id, row, k1, k2) for each document and line key. A key's
  reference count is its number of rows there, its keeper the smallest doc_id.
* `flagged` holds the keys that a filter knew already when another document brought them.

A document's keys are put to the filters first. A key that its filter does not know is new: it goes into the filter and
is not counted. Only keys that a filter knows are looked up and counted in the exact table, which also settles the
filter's false positives. Most lines of a corpus stand in one document, so most keys are never counted.
Inserting appends rows to the shards of the new lines; deleting rewrites the shards of the lines that go; shards that no
line falls into are neither read nor written. Each change leaves a new version beside the old one, which stays usable.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from corpusloom.llm.batches import sliced, texts_of
from corpusloom.llm.cuckoo import CuckooFilter, filter_of
from corpusloom.runtime import free_names, materialize, materialize_last, scratch, ship

#: White space that is stripped from both ends of a line.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Rows without a doc_id count as one document after all others.
LAST = (1 << 63) - 1
#: References that a task folds together, keys that a filter takes in at a time, files that a shard's references are dealt to.
FOLD, PASS, SALTS = 500_000, 65_536, 4


def line_key(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key, None if the key is shorter than `least` code points."""
    key = line.strip(BLANK).lower()  # bytes.lower() changes A-Z only
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_references(docs: DataFrame, *, least: int = 10) -> DataFrame:
    """doc_id, row, k1, k2: each line key of each document once a row of docs; row is a hash of its text, which tells rows that share a doc_id."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, rows, keys = [], [], []
            for doc_id, row, text in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), texts_of(batch), strict=True):
                found = {k for line in text.encode().split(b"\n") if (k := line_key(line, least))}
                keys += found
                ids += [LAST if doc_id is None else doc_id] * len(found)
                rows += [row] * len(found)
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "row", "k1", "k2"])

    return docs.select("doc_id", "text", row_hash().alias("row")).mapInArrow(run, "doc_id long, row long, k1 long, k2 long")


def row_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def folded(references: DataFrame, held: bool) -> DataFrame:
    """shard, k1, k2, refs, held: references (shard, k1, k2) with a task's equal keys folded, so that a very common key is a row a task and not one a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[pa.RecordBatch] = []

        def fold() -> pa.RecordBatch:
            table = pa.Table.from_batches(part).group_by(["shard", "k1", "k2"]).aggregate([("k1", "count"), *([("held", "max")] if held else [])])
            part.clear()
            known = table["held_max"] if held else pa.array(np.zeros(len(table), bool))
            return pa.table({"shard": table["shard"], "k1": table["k1"], "k2": table["k2"], "refs": table["k1_count"], "held": known}).combine_chunks().to_batches()

        for batch in batches:
            part.append(batch)
            if sum(x.num_rows for x in part) >= FOLD:
                yield from fold()
        if part:
            yield from fold()

    return references.select("shard", "k1", "k2", *["held"] * held).mapInArrow(run, "shard int, k1 long, k2 long, refs long, held boolean")


def pour(filter_: CuckooFilter, keys: pa.Table) -> np.ndarray:
    """Insert keys (k1, refs, held) into the filter and return whether each row's key is repeated.

    PASS rows at a time are put to the filter. A key that it does not know is new: it is inserted and not counted. Keys
    that it knows, or that stand several times in one pass, are counted exactly: one is repeated if documents from
    before hold it or it has more references than one; if not, the filter took it for another.
    """
    k, refs, before = keys["k1"].to_numpy().view(np.uint64), keys["refs"].to_numpy(), keys["held"].to_numpy().astype(bool)
    flagged, inserted = refs > 1, [k[:0]]
    for first in range(0, len(k), PASS):
        part = slice(first, first + PASS)
        distinct, at, times = np.unique(k[part], return_inverse=True, return_counts=True)
        known = filter_.contains(distinct)
        flagged[part] |= (known | (times > 1))[at]
        inserted.append(distinct[~known])
        filter_.insert(inserted[-1])
    asked = np.unique(k[flagged])
    # a key's first row may have passed as new: it counts too
    rows = np.flatnonzero(np.isin(k, asked))
    at = np.searchsorted(asked, k[rows])
    total, old = np.bincount(at, refs[rows], len(asked)), np.bincount(at, before[rows], len(asked)) > 0
    # never inserted, as the filter took it for another from its first row on
    filter_.insert(asked[~old & ~np.isin(asked, np.concatenate(inserted))])
    return np.isin(k, asked[(total > 1) | old])


def shard_of(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def drop_lines(docs: DataFrame, doomed: DataFrame, *, least: int = 10, keep_text: bool = True) -> DataFrame:
    """The rows of docs without the lines whose key doomed (doc_id, row, k1, k2) names for that row of that document.

    Returned: the columns of docs, text shortened (left out without keep_text), then n_lines, n_dropped, kept_sha256
    in place of any of docs' columns of these names. A row is sent its own lines' keys only, so rows that share a
    doc_id, or have none, cost no more than others.
    """
    figures = ["n_lines", "n_dropped", "kept_sha256"]
    carried = [c for c in docs.columns if c not in figures and c != "text"]
    key, row, first, second = free_names([*carried, "text", *figures, "doc_id", "row", "k1", "k2"], "_id", "_row", "_a", "_b")
    lists = doomed.groupBy("doc_id", "row").agg(F.collect_set(F.struct("k1", "k2")).alias("keys")).select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("keys.k1").alias(first), F.col("keys.k2").alias(second))
    keyed = docs.select(*carried, "text").withColumns({key: F.coalesce("doc_id", F.lit(LAST)), row: row_hash()})
    schema = StructType([docs.schema[c] for c in carried] + [StructField("text", StringType())] * keep_text)
    schema = schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text, a, b in zip(texts_of(batch), batch[first], batch[second], strict=True):
                lines = text.encode().split(b"\n")
                kept = lines
                if a.is_valid:
                    gone = {bytes(x) for x in np.stack([a.values.to_numpy(), b.values.to_numpy()], 1).view("V16").ravel()}
                    kept = [x for x in lines if line_key(x, least) not in gone]
                data = b"\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(data).hexdigest(), data.decode() if keep_text else ""))
            n, dropped, sha, texts = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
            columns = [batch[c] for c in carried] + [pa.array(texts, pa.string())] * keep_text
            columns += [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, carried + ["text"] * keep_text + figures)

    return keyed.join(lists, [key, row], "left").select(*carried, "text", first, second).mapInArrow(run, schema)


class LineIndex:
    """A version of the index of a corpus; see the module's description."""

    #: Keys that one shard's filter is meant for; sets the number of shards.
    SHARD_KEYS = 100_000

    def __init__(self, spark: SparkSession, path: str, *, shards: int, least: int, files: dict[int, tuple[int, ...]], filters: dict[int, int]):
        """files: the versions whose reference rows are a shard's; filters: the version of its filter. A number or two a shard."""
        self.spark, self.path, self.shards, self.least, self.files, self.versions = spark, path, shards, least, files, filters

    @classmethod
    def build(cls, docs: DataFrame, *, least: int = 10) -> LineIndex:
        spark = docs.sparkSession
        new = materialize(line_references(docs, least=least), "line-new")
        shards = max(16, -(-new.count() // cls.SHARD_KEYS))
        return cls(spark, scratch(spark, "line-index"), shards=shards, least=least, files={}, filters={})._with(new)

    def _table(self, name: str, schema: str, of: dict[int, tuple[int, ...]], shards: list[int] | None = None) -> DataFrame:
        """Rows of the (shard, version) folders that `of` lists, those of `shards` only."""
        if not of:
            return self.spark.createDataFrame([], schema)
        wanted = [(s, v) for s, versions in of.items() if shards is None or s in shards for v in versions]
        by_version: dict[int, list[int]] = {}
        for s, v in wanted:
            by_version.setdefault(v, []).append(s)
        rows = self.spark.read.schema(f"{schema}, version int").parquet(f"{self.path}/{name}")
        chosen = F.lit(False)
        for v, own in by_version.items():
            chosen = chosen | (F.col("version") == v) & (F.lit(True) if len(own) == self.shards else F.col("shard").isin(own))
        return rows.where(chosen)

    def references(self, shards: list[int] | None = None) -> DataFrame:
        """shard, doc_id, row, k1, k2 of the documents that the index holds; with shards, only those are read."""
        return self._table("references", "doc_id long, row long, k1 long, k2 long, shard int", self.files, shards)

    def filters(self, shards: list[int] | None = None) -> DataFrame:
        """shard, filter, n of each shard that has keys."""
        return self._table("filters", "filter binary, n long, shard int", {s: (v,) for s, v in self.versions.items()}, shards)

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "shard").parquet(f"{self.path}/{name}")

    def _shards_in(self, rows: DataFrame) -> list[int]:
        return sorted(r.shard for r in rows.select("shard").distinct().collect())

    def known(self, keys: DataFrame) -> DataFrame:
        """shard, k1, k2 of those of the distinct keys (k1, k2) that a filter knows: the only ones that can have references."""

        def probe(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.slice(0, 0)
            return left.filter(pa.array(CuckooFilter.from_bytes(right["filter"][0].as_py()).contains(left["k1"].to_numpy().view(np.uint64))))

        asked = keys.select("k1", "k2", shard_of(self.shards).alias("shard"))
        touched = self._shards_in(asked)
        found = asked.groupBy("shard").cogroup(self.filters(touched).groupBy("shard")).applyInArrow(probe, "k1 long, k2 long, shard int")
        return found.select("shard", "k1", "k2")

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with docs (doc_id, text) added. Their doc_ids must be new."""
        return self._with(materialize(line_references(docs, least=self.least), "line-new"))

    def _with(self, new: DataFrame) -> LineIndex:
        version = 1 + max((v for versions in self.files.values() for v in versions), default=0)
        new = new.withColumn("shard", shard_of(self.shards))
        # a very common line's rows are dealt to several files of its shard
        self._write(new.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "references", version)
        touched = [int(s) for s in self._shards_in(new)]
        asked = new
        if self.files:
            # only what the filters know is looked up, and only in its shards
            maybe = materialize(self.known(new.select("k1", "k2").distinct()), "line-known")
            held = maybe.join(self.references(self._shards_in(maybe)).select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").withColumn("held", F.lit(True))
            asked = new.join(materialize(held, "line-held").select("k1", "k2", "held"), ["k1", "k2"], "left").withColumn("held", F.coalesce("held", F.lit(False)))

        def settle(keys: pa.Table, old: pa.Table) -> pa.Table:
            shard, room = keys["shard"][0].as_py(), len(keys)
            while True:
                filter_ = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else CuckooFilter(room)
                try:
                    repeated = pour(filter_, keys)
                    break
                except OverflowError:  # a new filter is tried larger; an old one was given room before
                    if old.num_rows:
                        raise
                    room = 2 * room
            ours = pa.table(keys.filter(pa.array(repeated)).group_by(["k1", "k2"]).aggregate([])).to_pydict()
            rows = [(filter_.to_bytes(), filter_.held, None, None), *((None, None, a, b) for a, b in zip(ours["k1"], ours["k2"], strict=True))]
            filters, n, k1, k2 = zip(*rows, strict=True)
            return pa.table({"shard": pa.array([shard] * len(rows), pa.int32()), "filter": pa.array(filters, pa.binary()), "n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64())})

        crowded = self._crowded(asked)
        filters = self.filters([s for s in touched if s not in crowded])
        if crowded:
            # a filter without room is built anew from the shard's exact rows, large enough for the new ones too
            filters = filters.select("shard", "filter").unionByName(self._rebuilt(crowded))
        folds = folded(asked, bool(self.files)).groupBy("shard")
        settled = materialize(folds.cogroup(filters.select("shard", "filter").groupBy("shard")).applyInArrow(settle, "shard int, filter binary, n long, k1 long, k2 long"), "line-settled")
        self._write(settled.where("filter is not null").select("shard", "filter", "n"), "filters", version)
        self._write(settled.where("filter is null").select("shard", "k1", "k2").repartition("shard"), "flagged", version)
        files = self.files | {s: (*self.files.get(s, ()), version) for s in touched}
        return LineIndex(self.spark, self.path, shards=self.shards, least=self.least, files=files, filters=self.versions | dict.fromkeys(touched, version))

    def _crowded(self, asked: DataFrame) -> dict[int, int]:
        """Shards whose filter has no room for the rows of asked, and the keys to make room for."""
        if not self.files:
            return {}
        coming = {r.shard: r.n for r in asked.where("not held").groupBy("shard").agg(F.count_distinct("k1", "k2").alias("n")).collect()}
        there = {r.shard: (r.n, r.room) for r in self.filters(list(coming)).select("shard", "n", (F.octet_length("filter") / 2).alias("room")).collect()}
        return {s: there[s][0] + n for s, n in coming.items() if s in there and there[s][0] + n > 0.8 * there[s][1]}

    def _rebuilt(self, crowded: dict[int, int]) -> DataFrame:
        """shard, filter of larger filters over the keys that the references of these shards hold."""

        def build(group: pa.Table) -> pa.Table:
            distinct = np.unique(group["k1"].to_numpy().view(np.uint64))
            shard = group["shard"].combine_chunks()[:1]
            return pa.table({"shard": shard, "filter": pa.array([filter_of(distinct, 2 * crowded[shard[0].as_py()]).to_bytes()], pa.binary())})

        return self.references(list(crowded)).select("shard", "k1").distinct().groupBy("shard").applyInArrow(build, "shard int, filter binary")

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the documents docs (doc_id, text), as they were inserted: their lines' next holders become keepers."""
        version = 1 + max((v for versions in self.files.values() for v in versions), default=0)
        gone = materialize(line_references(docs, least=self.least).select("doc_id", "k1", "k2", shard_of(self.shards).alias("shard")).distinct(), "line-gone")
        touched = self._shards_in(gone)
        left = self.references(touched).select("shard", "doc_id", "row", "k1", "k2").join(gone, ["shard", "doc_id", "k1", "k2"], "left_anti")
        left = materialize(left, "line-left")
        self._write(left.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), "references", version)
        held = self.references(touched).join(gone, ["shard", "doc_id", "k1", "k2"]).select("shard", "k1").distinct()
        unheld = held.join(left.select("k1").distinct(), "k1", "left_anti")

        def change(old: pa.Table, keys: pa.Table) -> pa.Table:
            if not old.num_rows:
                return pa.table({"shard": pa.array([], pa.int32()), "filter": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
            filter_ = CuckooFilter.from_bytes(old["filter"][0].as_py())
            if keys.num_rows:
                filter_.delete(keys["k1"].to_numpy().view(np.uint64))
            return pa.table({"shard": old["shard"].combine_chunks()[:1], "filter": pa.array([filter_.to_bytes()], pa.binary()), "n": pa.array([filter_.held], pa.int64())})

        changed = self.filters(touched).select("shard", "filter").groupBy("shard").cogroup(unheld.groupBy("shard")).applyInArrow(change, "shard int, filter binary, n long")
        self._write(changed, "filters", version)
        there = [s for s in touched if s in self.versions]
        files = self.files | {s: (version,) for s in there}
        return LineIndex(self.spark, self.path, shards=self.shards, least=self.least, files=files, filters=self.versions | dict.fromkeys(there, version))

    def flagged(self) -> DataFrame:
        """k1, k2 that a filter knew when another document brought them, in any version up to this one: a superset of the repeated keys."""
        newest = max((v for versions in self.files.values() for v in versions), default=0)
        try:
            rows = self.spark.read.schema("k1 long, k2 long, shard int, version int").parquet(f"{self.path}/flagged")
        except AnalysisException:  # no key was ever flagged
            return self.spark.createDataFrame([], "k1 long, k2 long")
        return rows.where(F.col("version") <= newest).select("k1", "k2").distinct()

    def doomed(self) -> DataFrame:
        """doc_id, row, k1, k2 of the lines that go: their key is held by a smaller doc_id as well. Flagged keys only are counted."""
        flagged = self.flagged()
        # written, so that the joins with a very common key's rows can be split
        hits = materialize(self.references().select("doc_id", "row", "k1", "k2").join(flagged, ["k1", "k2"]), "line-hits")
        counted = hits.groupBy("k1", "k2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).where("keeper < last")
        counted = materialize(counted.select("k1", "k2", "keeper"), "line-repeated")
        return hits.join(counted, ["k1", "k2"]).where("doc_id > keeper").select("doc_id", "row", "k1", "k2")


def dedup_lines(docs: DataFrame, *, least: int = 10, keep_text: bool = True) -> DataFrame:
    """The rows of docs (doc_id, text; other columns pass through) as drop_lines returns them.

    Keys of at least `least` code points that at least two documents hold lose all their lines except in the smallest
    doc_id. Null or empty text: one empty line, kept. Null doc_id: all such rows count as one document after all
    others. Rows that repeat a doc_id count as one document, and each comes out. Empty table: no rows.
    """
    doomed = materialize_last(lambda: LineIndex.build(docs, least=least).doomed(), docs.sparkSession, "line-doomed")
    return drop_lines(docs, doomed, least=least, keep_text=keep_text)


def op10(spark, sf_dir: str) -> DataFrame:
    """dedup_lines over documents, without their texts: doc_id, n_lines, n_dropped, kept_sha256. Nulls, empty and very long texts, ties and repeated rows as there; other columns are not looked at."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), held AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (keeper < doc_id)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper >= doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id
"""
