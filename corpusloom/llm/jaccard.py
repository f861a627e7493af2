"""N-gram Jaccard join by prefix trees.

Tokens are hashes of word n-grams under one global order: rare ones by hash, then the frequent ones. Two sets of the
wanted similarity share a token among each one's first few (its prefix), so:

1. Documents with equal sets become one class, represented by its smallest doc_id.
2. Prefix tokens are dealt by token. Of the few classes that share a rare one, each pair of fitting sizes is counted,
   and tied if it shares as many prefix tokens as similarity takes: what a pair shares is at most its shared prefix
   tokens and one side's tokens beyond its prefix. Classes that share a token with many others are only marked.
3. Marked classes, made of common phrases as they are, are tied by cells: their tokens are dealt by hash into more
   cells than half the tokens in which a similar set can differ, so one cell differs in one token at most, and three of
   its four quarters are equal. Classes with equal quarters are tied to one of them, a tie for each class and cell,
   whatever their number.
4. Classes that ties connect are a candidate group; no similar pair lies across two. Each class of a group sends its
   whole set to the group's task once, where a trie over the ordered sets is walked with shared partial overlaps and
   pruned by what can still follow.
5. Groups larger than a block are cut into blocks with a few common pivots. Then the documents outside the group's
   largest part, the only ones that can still be linked with another part, are compared with all its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import sliced, texts_of
from corpusloom.llm.components import components
from corpusloom.llm.hashing import mix64
from corpusloom.llm.shingles import Shingler
from corpusloom.llm.trie import link, needed
from corpusloom.runtime import materialize, materialize_last, parts_for, passing, release, scratch, ship, sifted

#: Tokens in this many prefixes or more count as frequent, and how many of them the order knows (the most frequent).
#: Both only steer the work: any order finds every link.
FREQUENT, KNOWN = 8, 200_000
#: Sets in a task's block, pivots that all blocks of a group have in common, blocks that are compared together with the documents outside the largest part.
BLOCK, PIVOTS, WIDE = 112, 14, 8
#: Classes that share a token up to which they are counted in pairs; more are marked.
FEW = 16
#: Bytes of the table on disk for which there is one part at least.
TASK_BYTES = 64 << 20
#: Tokens or cells that a task holds before it folds equal ones together.
HELD = 400_000


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Tokens as numbers in the global order: the top bit marks frequent ones."""
    tokens = tokens >> np.uint64(1)
    if len(frequent):
        known = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        tokens = np.sort(tokens | known.astype(np.uint64) << np.uint64(63))
    return tokens


def size_class(n: int, percent: int) -> int:
    """Similar sets are of the same size class or of neighbouring ones."""
    return int(np.log(n) / np.log(100.1 / percent))


def cell_count(of: int, percent: int) -> tuple[int, int]:
    """For sets of a size class or the one below: how many cells, and in how many of them a pair of similar sets can differ in more than one token."""
    most = int((100.1 / percent) ** (of + 1)) + 1
    twice = 2 * most * (100 - percent) // (100 + percent) // 2
    return twice + 2 + twice * 4 // 100, twice


def cells(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which a similar set has one at least: of three quarters of a cell, for all cells and for both size classes that a similar set can be of.

    There are more cells than half the tokens in which similar sets can differ, so one cell differs in one token at
    most, and three of its quarters are equal. Quarters without tokens say nothing: a set that has too few cells with
    tokens in two quarters gives its prefix tokens as well, and meets the others of that kind by them.
    """
    out = []
    own = size_class(len(tokens), percent)
    bare = tokens & np.uint64((1 << 63) - 1)
    dealt, mixed = mix64(bare, 31), mix64(bare, 33)
    for of in (own, own + 1):
        n, twice = cell_count(of, percent)
        quarter = (dealt % np.uint64(n)).astype(np.int64) * 4 + (dealt >> np.uint64(62)).astype(np.int64)
        sums = np.zeros(4 * n, np.uint64)
        np.add.at(sums, quarter, mixed)
        sums, held = sums.reshape(n, 4), np.bincount(quarter, minlength=4 * n).reshape(n, 4)
        rest, left = sums.sum(1, dtype=np.uint64)[:, None] - sums, held.sum(1)[:, None] - held
        which = np.flatnonzero(left.ravel())
        out.append(mix64(rest.ravel()[which]) + mix64(which.astype(np.uint64) + (np.uint64(of) << np.uint64(40)), 35))
        if (left > 0).all(1).sum() <= twice:
            out.append(mix64(tokens[: prefix_size(len(tokens), percent)], 37 + of))
    return np.concatenate(out)


def by_bucket(bucket: np.ndarray, n: int, *columns: np.ndarray) -> tuple[pa.Array, list[pa.Array]]:
    """The used ones of n buckets, and of each column the part of each bucket as bytes."""
    order = np.argsort(bucket, kind="stable")
    edge = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))
    used = np.flatnonzero(np.diff(edge))
    return pa.array(used.astype(np.int32)), [pa.array([x[order[edge[b] : edge[b + 1]]].tobytes() for b in used], pa.binary()) for x in columns]


def aside(known: np.ndarray, used: pa.Array, packed: list[pa.Array], names: list[str], buckets: int) -> pa.RecordBatch:
    """Rows of used buckets with their packed columns, and a row of what is known already, as ids, for one of as many buckets below zero."""
    from pyspark import TaskContext

    own = pa.array([-1 - TaskContext.get().partitionId() % buckets], pa.int32())
    first = [pa.array([known.tobytes() if name == "ids" else b""], pa.binary()) for name in names]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([own, used]), *(pa.concat_arrays(x) for x in zip(first, packed, strict=True))], ["bucket", *names])


class JaccardJoin:
    def __init__(self, docs: DataFrame, *, words: int, percent: int):
        self.spark, self.words, self.percent = docs.sparkSession, words, percent
        ship(self.spark)
        self.docs = docs.select("doc_id", "text")
        #: Tasks that what is dealt goes to, by the bytes of the table.
        self.parts = parts_for(self.docs, TASK_BYTES)
        self.buckets = 4 * self.parts

    def frequent(self) -> np.ndarray:
        """The most frequent tokens of the prefixes that hashes alone would give; at most KNOWN, so that all tasks may have them."""
        words, percent, buckets = self.words, self.percent, self.buckets

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(words)
            for batch in sliced(batches):
                sets = [s[: prefix_size(len(s), percent)] >> np.uint64(1) for s in shingle(texts_of(batch)) if len(s)]
                if sets:
                    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                    used, packed = by_bucket((tokens % np.uint64(buckets)).astype(np.int32), buckets, tokens, counts.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([used, *packed], ["bucket", "tokens", "counts"])

        def count(group: pa.Table) -> pa.Table:
            tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64)
            counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.int32)
            distinct, back = np.unique(tokens, return_inverse=True)
            total = np.bincount(back, counts).astype(np.int64)
            many = total >= FREQUENT
            return pa.table({"token": distinct[many].view(np.int64), "n": total[many]})

        found = self.docs.select("text").mapInArrow(emit, "bucket int, tokens binary, counts binary").groupBy("bucket").applyInArrow(count, "token long, n long")
        top = found.orderBy(F.desc("n"), "token").limit(KNOWN).select("token").toArrow()
        return np.sort(top["token"].to_numpy().view(np.uint64))

    def signatures(self, frequent) -> DataFrame:
        """doc_id, n, a, b, prefix: size and 128-bit hash of each document's set, and its prefix in the global order."""
        words, percent = self.words, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(words)
            for batch in sliced(batches):
                sets = shingle(texts_of(batch))
                a = np.array([mix64(s, 5).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                b = np.array([np.bitwise_xor.reduce(mix64(s, 9)) for s in sets], np.uint64).view(np.int64)
                prefix = [ordered(s, frequent.value)[: prefix_size(len(s), percent)].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array(prefix, pa.binary())], ["doc_id", "n", "a", "b", "prefix"])

        return self.docs.mapInArrow(run, "doc_id long, n long, a long, b long, prefix binary")

    def pairs(self, classes: DataFrame) -> DataFrame:
        """u, v, least, shared: what classes (doc_id, n, prefix) that share rare tokens share in each bucket, and what ties them; u = v: marked classes."""
        percent, buckets = self.percent, self.buckets

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part: list[tuple[np.ndarray, ...]] = []

            def fold() -> pa.RecordBatch:
                tokens, ids, n = (np.concatenate(x) for x in zip(*part, strict=True))
                part.clear()
                # of a token that is common in this task already, a few classes tell the others' tasks; all are marked here
                order = np.argsort(tokens, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], tokens[order][1:] != tokens[order][:-1])))
                size = np.diff(np.append(starts, len(tokens)))
                nth, many = np.arange(len(tokens)) - np.repeat(starts, size), np.repeat(size > FEW, size)
                marked, sent = np.unique(ids[order[many]]), order[nth <= FEW]
                used, packed = by_bucket((tokens[sent] % np.uint64(buckets)).astype(np.int32), buckets, tokens[sent], ids[sent], n[sent])
                return aside(marked, used, packed, ["tokens", "ids", "n"], buckets)

            for batch in batches:
                lists = [np.frombuffer(p, np.uint64) for p in batch["prefix"].to_pylist()]
                sizes = [len(x) for x in lists]
                if lists:
                    part.append((np.concatenate(lists), np.repeat(batch["doc_id"].to_numpy(), sizes), np.repeat(batch["n"].to_numpy().astype(np.int32), sizes)))
                if sum(len(x[0]) for x in part) > HELD:
                    yield fold()
            if part:
                yield fold()

        def tie(group: pa.Table) -> pa.Table:
            if group["bucket"][0].as_py() < 0:
                marked = np.unique(np.frombuffer(b"".join(group["ids"].to_pylist()), np.int64))
                return pa.table({"u": marked, "v": marked, "least": np.ones(len(marked), np.int64), "shared": np.ones(len(marked), np.int64)})
            tokens, ids, n = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("tokens", np.uint64), ("ids", np.int64), ("n", np.int32)))
            order = np.lexsort((ids, n, tokens))
            tokens, ids, n = tokens[order], ids[order], n[order].astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            size = np.diff(np.append(starts, len(tokens)))
            many = np.repeat(size > FEW, size)
            marked = np.unique(ids[many])
            tokens, ids, n = tokens[~many], ids[~many], n[~many]
            out = [np.stack([marked, marked, np.ones(len(marked), np.int64)], 1)]
            for step in range(1, min(FEW, len(tokens))):
                a, b = slice(0, len(tokens) - step), slice(step, None)
                at = np.flatnonzero((tokens[b] == tokens[a]) & (100 * n[a] >= percent * n[b]) & (ids[b] != ids[a]))
                x, y = n[at], n[at + step]
                rest = np.maximum(x - prefix_size(x, percent), y - prefix_size(y, percent))
                out.append(np.stack([np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step]), np.maximum(needed(x, y, percent) - rest, 1)], 1))
            rows, count = np.unique(np.concatenate(out), axis=0, return_counts=True)
            return pa.table({"u": rows[:, 0], "v": rows[:, 1], "least": rows[:, 2], "shared": count.astype(np.int64)})

        dealt = classes.select("doc_id", "n", "prefix").mapInArrow(deal, "bucket int, tokens binary, ids binary, n binary")
        return dealt.groupBy("bucket").applyInArrow(tie, "u long, v long, least long, shared long")

    def cell_ties(self, marked: DataFrame, frequent) -> DataFrame:
        """u, v: ties of the marked classes (doc_id) by equal cells."""
        percent, buckets, words = self.percent, self.buckets, self.words

        def star(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places of one row of each hash, and the distinct ties of the others' ids with its id."""
            distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            pairs = np.stack([ids, ids[first][back]], 1)
            return first, np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle, part = Shingler(words), []

            def fold() -> pa.RecordBatch:
                hashes, ids = (np.concatenate(x) for x in zip(*part, strict=True))
                part.clear()
                # a cell that many classes of this task have goes on once, the others are tied to it here
                first, ties = star(hashes, ids)
                used, packed = by_bucket((hashes[first] % np.uint64(buckets)).astype(np.int32), buckets, hashes[first], ids[first])
                return aside(ties, used, packed, ["hashes", "ids"], buckets)

            for batch in sliced(batches):
                for doc_id, tokens in zip(batch["doc_id"].to_pylist(), shingle(texts_of(batch)), strict=True):
                    if len(tokens):
                        found = cells(ordered(tokens, frequent.value), percent)
                        part.append((found, np.full(len(found), doc_id, np.int64)))
                if sum(len(x[0]) for x in part) > HELD:
                    yield fold()
            if part:
                yield fold()

        def tie(group: pa.Table) -> pa.Table:
            if group["bucket"][0].as_py() < 0:
                pairs = np.unique(np.frombuffer(b"".join(group["ids"].to_pylist()), np.int64).reshape(-1, 2), axis=0)
                return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})
            hashes, ids = (np.frombuffer(b"".join(group[c].to_pylist()), kind) for c, kind in (("hashes", np.uint64), ("ids", np.int64)))
            pairs = star(hashes, ids)[1]
            return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

        # the marked classes grow with the corpus: merged at every size, never sent to all tasks; the texts of others stay where they are
        texts = sifted(self.docs, marked, "doc_id")[0].join(marked.hint("merge"), "doc_id")
        return texts.mapInArrow(deal, "bucket int, hashes binary, ids binary").groupBy("bucket").applyInArrow(tie, "u long, v long")

    def sets(self, members: DataFrame, frequent) -> DataFrame:
        """members (doc_id, cluster, blocks) with the documents' ordered sets and a block."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingle = Shingler(words)
            for batch in sliced(batches):
                found = [ordered(s, frequent.value).tobytes() for s in shingle(texts_of(batch))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["cluster"], batch["blocks"], pa.array(found, pa.binary())], ["doc_id", "cluster", "blocks", "tokens"])

        # the members grow with the corpus: merged at every size, never sent to all tasks
        texts = sifted(self.docs, members, "doc_id")[0].join(members.hint("merge"), "doc_id")
        return texts.select("doc_id", "cluster", "blocks", "text").mapInArrow(run, "doc_id long, cluster long, blocks int, tokens binary")

    def linked(self, rows: DataFrame) -> DataFrame:
        """u, v that connect what links connect within each (cluster, block) of rows (doc_id, cluster, block, part, tokens); equal parts are connected already."""
        percent = self.percent

        def run(group: pa.Table) -> pa.Table:
            out: list[tuple[int, int]] = []
            by: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(group["cluster"].to_pylist(), group["block"].to_pylist(), strict=True)):
                by.setdefault(key, []).append(i)
            ids, parts, tokens = group["doc_id"].to_pylist(), group["part"].to_pylist(), group["tokens"]
            for places in by.values():
                sets = [np.frombuffer(tokens[i].as_py(), np.uint64) for i in places]
                out += [(ids[places[a]], ids[places[b]]) for a, b in link(sets, percent, [parts[i] for i in places])]
            return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

        # small clusters share tasks, each block of a large one has its own
        task = F.pmod(F.xxhash64("cluster", "block"), F.lit(8 * self.parts)).cast("int")
        return rows.withColumn("task", task).groupBy("task").applyInArrow(run, "u long, v long")

    def signed(self, frequent) -> tuple[DataFrame, DataFrame, DataFrame]:
        """doc_id, n, a, b of each row, the ties u, v of the classes and the marked ones. The prefixes, a fifth of all sets, are on disk until the ties are made."""
        path = scratch(self.spark, "jaccard-signed")
        with passing(self.spark):
            sets = materialize(self.signatures(frequent), "jaccard-sets")
            held = sets.where("n > 0 and doc_id is not null")
            classes = held.groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "prefix")).alias("first"))
            pairs = self.pairs(classes.select("n", F.col("first.doc_id").alias("doc_id"), F.col("first.prefix").alias("prefix")))
            pairs.write.parquet(f"{path}/pairs")
            small = sets.select("doc_id", "n", "a", "b")
            small.write.parquet(f"{path}/sets")
        pairs = self.spark.read.schema(pairs.schema).parquet(f"{path}/pairs")
        ties = pairs.where("u <> v").groupBy("u", "v").agg(F.min("least").alias("least"), F.sum("shared").alias("shared")).where("shared >= least").select("u", "v")
        marked = materialize(pairs.where("u = v").select(F.col("u").alias("doc_id")).distinct(), "jaccard-marked")
        return self.spark.read.schema(small.schema).parquet(f"{path}/sets"), ties, marked

    def run(self) -> DataFrame:
        frequent = self.spark.sparkContext.broadcast(self.frequent())
        signed, ties, marked = self.signed(frequent)
        if not marked.isEmpty():
            ties = ties.unionByName(self.cell_ties(marked, frequent))
        release(self.spark)
        classes = signed.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("doc_id"))
        clusters = components(ties).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "cluster")
        release(self.spark)
        sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        members = self.sets(clusters.join(sizes, "cluster"), frequent)
        members = materialize(members.withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")), "jaccard-members")
        # pivots: the documents of smallest hash, as many of each large cluster as PIVOTS on average
        pivot = F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.col("blocks") * (BLOCK // PIVOTS)) == 0
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        pivots = members.where((F.col("blocks") > 1) & pivot).withColumn("home", F.col("block")).withColumn("block", every).where("block <> home").drop("home")
        columns = ["doc_id", "cluster", "block", "tokens"]
        first = members.select(*columns).unionByName(pivots.select(*columns)).withColumn("part", F.col("doc_id"))
        edges = materialize(self.linked(first), "jaccard-links")
        large = members.where("blocks > 1")
        if not large.isEmpty():
            edges = materialize(edges.unionByName(self.across(large, edges)), "jaccard-links")
        parts = components(edges).select(F.col("id").alias("rep"), "component")
        reps = classes.select("n", "a", "b", F.col("doc_id").alias("rep")).join(parts, "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
        linked = signed.select("doc_id", "n", "a", "b").join(reps, ["n", "a", "b"], "left")
        return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"))

    def across(self, large: DataFrame, edges: DataFrame) -> DataFrame:
        """Links between the parts of clusters of more than one block."""
        parts = components(edges).select(F.col("id").alias("doc_id"), F.col("component").alias("part"))
        places = large.select("doc_id", "cluster", "block", "blocks").join(parts, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
        places = materialize(places, "jaccard-places")
        count = places.groupBy("cluster", "part").count()
        main = count.groupBy("cluster").agg(F.max(F.struct("count", "part")).alias("m")).select("cluster", F.col("m.part").alias("main"))
        minor = places.join(main, "cluster").withColumn("minor", F.col("part") != F.col("main")).drop("main")
        # minor documents go to all of their cluster, WIDE blocks together and some at a time; clusters of one part are done
        minor = minor.withColumn("block", F.floor(F.col("block") / WIDE).cast("int")).withColumn("blocks", F.ceil(F.col("blocks") / WIDE).cast("int"))
        turns = minor.where("minor").groupBy("cluster").agg(F.ceil(F.count("*") / (BLOCK * WIDE)).cast("int").alias("turns"))
        turns = materialize(turns, "jaccard-turns")
        if turns.isEmpty():
            return edges.limit(0)
        turn = F.pmod(F.xxhash64("doc_id", F.lit("turn")), "turns").cast("int")
        held = large.join(turns, "cluster").select("doc_id", "tokens", "turns").join(minor, "doc_id").withColumn("turn", turn)
        held = held.withColumn("home", F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
        sent = held.withColumn("home", F.explode("home")).withColumn("seat", F.explode(F.when(F.col("home") == F.col("block"), F.sequence(F.lit(0), F.col("turns") - 1)).otherwise(F.array("turn"))))
        return self.linked(sent.select("doc_id", "cluster", (F.col("home") * F.col("turns") + F.col("seat")).alias("block"), "part", "tokens"))


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; other columns are not looked at).

    Sets are distinct runs of `words` words; two documents link when 100 * intersection >= percent * union, and
    component_id is the smallest doc_id that links reach. Null, empty and blank texts have an empty set and no
    links. Rows without doc_id are counted but take no part in links; their component_id is null. Rows that repeat a
    doc_id are each looked at, as sets of one document. Empty table: no rows.
    """
    return materialize_last(JaccardJoin(docs, words=words, percent=percent).run, docs.sparkSession, "jaccard-components")


def op9(spark, sf_dir: str) -> DataFrame:
    """jaccard_components over documents, 4 words and 85 percent. Nulls, empty and very long texts, ties and repeated rows as there; other columns are not looked at."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


OP9_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM worded
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM shingled
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM shingled
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id FROM shingled s JOIN reached r ON r.x = s.doc_id GROUP BY s.doc_id, s.s
"""
