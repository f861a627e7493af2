"""Binary token-id files with keyed access.

A store is a folder:

* `ids-NNNNN.bin`, the payload shards: 16 bytes of header (magic, id width, end id, reserved; four little-endian
  32-bit integers), then the raw ids of the shard's documents one after another, 16 bits each where the vocabulary
  fits and 32 otherwise. Shards, and documents in a shard, are in ascending doc_id order.
* `keys-NNNNN.idx`, the index buckets: a minimal perfect hash of the bucket's document keys and, at each key's
  number, a 32-bit fingerprint, the shard, the offset in ids and the number of ids. A document's key is its doc_id
  and, for rows that share one, which of them it is (nth, from 0). A key's bucket is a hash of it, so a look-up reads
  one bucket and costs the same in a store of any size.
* `shards`, a small Parquet table: shard, docs, ids, start (ids in all shards before).

Files are written under another name and renamed, so a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.batches import sliced
from corpusloom.llm.hashing import MinimalPerfectHash, mix64
from corpusloom.runtime import materialize, parts_for, qualified, scratch, ship

MAGIC = int.from_bytes(b"CLID", "little")
HEADER = 16
#: Keys that one index bucket is meant for, bytes of the table on disk that one payload shard is, rows of one doc_id that a task counts out.
BUCKET_KEYS, SHARD_BYTES, STRETCH = 250_000, 128 << 20, 100_000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_once(path: str, chunks: Iterator[bytes]) -> None:
    """Write a file in full or not at all."""
    store, place = open_store(path)
    draft = f"{place}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(draft) as out:
        for chunk in chunks:
            out.write(chunk)
    store.move(draft, place)


class WordIds:
    """Encodes texts with a tokenizers file that lower-cases, drops white space and never joins what it separates.

    For such a file a text's ids are those of its words one after another, so each distinct word goes through the
    library once, as long as it is remembered. A-Z are lower-cased first, which leaves the library fewer distinct
    words; texts with an added token's string or with combining marks keep their case, as there it decides. Letters
    and the signs that follow them are separate pre-tokens; unknown runs of letters go through the library together,
    and their last tokens, which the vocabulary marks, tell them apart. A file of another kind is refused.
    """

    #: The file's steps, which the shortcuts rest on.
    STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
    MARK = "</w>"

    def __init__(self, path: str, most: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = json.loads(self.library.to_str())
        kinds = tuple([x["type"] for x in (steps[part] or {}).get(name, [])] for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        if kinds != self.STEPS or steps["model"].get("end_of_word_suffix") != self.MARK or steps["post_processor"]:
            raise ValueError(f"{path} does not encode word by word")
        #: Strings that the library turns into an id wherever a text holds them, matched before it lower-cases.
        self.added = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.last[i] = token.endswith(self.MARK)
        self.known: dict[str, bytes] = {"": b""}
        self.signs: dict[str, bytes] = {"": b""}
        self.used, self.most = 0, most

    #: Letters that no normalisation joins with a neighbour, then ASCII signs.
    PLAIN = r"^(?P<stem>[a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<sign>[!-/:-@\[-`{-~]*)$"
    COMBINING = r"[\x{300}-\x{36F}]"

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, stems: list[str]) -> list[bytes]:
        """The ids of each run of letters: one pre-token, so it ends with its only marked token."""
        out: list[bytes] = []
        width = self.dtype.itemsize
        for first in range(0, len(stems), 2_000):
            part = stems[first : first + 2_000]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(ends) != len(part) or ends[-1] != ids.nbytes:
                out += self._each(part)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def learn(self, words: list[str]) -> None:
        """Put distinct unknown words into the memory, in a few calls of the library."""
        stems, signs = pc.extract_regex(pa.array(words, pa.string()), self.PLAIN).flatten()
        bare = pc.fill_null(pc.equal(signs, ""), False)
        signed = pc.fill_null(pc.not_equal(signs, ""), False)
        words = pa.array(words, pa.string())
        joined, stem, sign = (x.filter(signed).to_pylist() for x in (words, stems, signs))
        odd = words.filter(signs.is_null()).to_pylist()
        new = words.filter(bare).to_pylist()
        known = self.known
        new += set(filterfalse(known.__contains__, stem)).difference(new)
        known.update(zip(new, self._letters(new), strict=True))
        marks = list(set(sign).difference(self.signs))
        self.signs.update(zip(marks, self._each(marks), strict=True))
        known.update(zip(joined, map(add, map(known.__getitem__, stem), map(self.signs.__getitem__, sign)), strict=True))
        known.update(zip(odd, self._each(odd), strict=True))
        # an entry's key, value and slot
        self.used += 190 * (len(new) + len(joined) + len(odd)) + 2 * words.nbytes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. Null counts as empty."""
        if self.used > self.most:
            self.known, self.signs, self.used = {"": b""}, {"": b""}, 0
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        cased = pc.match_substring_regex(low, self.COMBINING)
        for token in self.added:
            cased = pc.or_(cased, pc.match_substring(low, token))
        lists = pc.ascii_split_whitespace(pc.if_else(cased, texts, low))
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = list(map(self.known.get, words))
        if new := [i for i, ids in enumerate(found) if ids is None]:
            self.learn([words[i] for i in new])
            for i in new:
                found[i] = self.known[words[i]]
        flat = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        ids = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


@lru_cache(maxsize=2)
def load(path: str) -> WordIds:
    return WordIds(path)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 101) >> np.uint64(32)).astype(np.uint32)


def key_hashes(group: pa.Table, seed: int) -> np.ndarray:
    """64-bit hashes of keys (doc_id, nth): distinct for the first rows of all doc_ids, whatever the seed."""
    ids = pc.fill_null(group["doc_id"], 0).to_numpy().astype(np.int64).view(np.uint64)
    again = 2 * group["nth"].to_numpy().astype(np.uint64) + group["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
    return mix64(ids, seed) ^ np.where(again > 0, mix64(again, seed + 50), np.uint64(0))


class TokenStore:
    """A store in a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.shards = spark.read.schema("shard int, docs long, ids long, start long").parquet(f"{path}/shards")

    @classmethod
    def write(cls, docs: DataFrame, path: str, *, tokenizer: str, end_id: int | None) -> TokenStore:
        """Encode docs (doc_id, text) and write the store. end_id is appended to each document."""
        spark = docs.sparkSession
        ship(spark)
        path = qualified(spark, path)
        store, place = open_store(path)
        store.create_dir(place, recursive=True)
        parts = parts_for(docs, SHARD_BYTES)
        # rows alike in doc_id and text may trade places; the last column spreads very many of them
        order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("spread")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            coder, shard = load(tokenizer), TaskContext.get().partitionId()
            width, rows = coder.dtype.itemsize, []

            def payload() -> Iterator[bytes]:
                at, row, before, times = 0, 0, (), 0
                yield np.array([MAGIC, width, -1 if end_id is None else end_id, 0], "<i4").tobytes()
                for part in sliced(batches, most=8 << 20):
                    ids, n = coder.encode(part["text"])
                    if end_id is not None:
                        ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                    starts = at + np.cumsum(n) - n
                    at += int(n.sum())
                    nth = []
                    for doc_id in part["doc_id"].to_pylist():
                        times = times + 1 if before == (doc_id,) else 0
                        before = (doc_id,)
                        nth.append(times)
                    rows.append(pa.RecordBatch.from_arrays([part["doc_id"], pa.array(np.full(len(n), shard, np.int32)), pa.array(row + np.arange(len(n))), pa.array(nth, pa.int64()), pa.array(starts), pa.array(n)], ["doc_id", "shard", "row", "nth", "offset", "n"]))
                    row += len(n)
                    yield ids.tobytes()

            write_once(f"{path}/ids-{shard:05d}.bin", payload())
            yield from rows

        ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("spread")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        placed = materialize(ranged.select("doc_id", "text").mapInArrow(run, "doc_id long, shard int, row long, nth long, offset long, n long"), "token-places")
        ends = placed.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"), F.min(F.struct("row", "doc_id")).alias("first"), F.max(F.struct("row", "doc_id", "nth")).alias("last"))
        # a row a file: where each shard starts, and how many rows of its first doc_id the shards before it hold
        start, table, last, held = 0, [], None, 0
        for r in ends.orderBy("shard").collect():
            base = held if last is not None and last.doc_id == r.first.doc_id else 0
            table.append((r.shard, r.docs, r.ids, start, r.first.doc_id, base))
            held = r.last.nth + 1 + (base if r.last.nth + 1 == r.docs else 0)
            start, last = start + r.ids, r.last
        shards = spark.createDataFrame(table, "shard int, docs long, ids long, start long, first long, base long")
        shards.drop("first", "base").coalesce(1).write.parquet(f"{path}/shards")
        carried = shards.where("base > 0").select("shard", F.col("first").alias("_first"), "base")
        nth = F.col("nth") + F.when(F.col("doc_id").eqNullSafe(F.col("_first")), F.coalesce("base", F.lit(0))).otherwise(0)
        if any(r[-1] for r in table):
            placed = placed.join(F.broadcast(carried), "shard", "left").withColumn("nth", nth)
        out = cls(spark, path, max(4 * parts, -(-sum(r[1] for r in table) // BUCKET_KEYS)))
        out._index(placed.select("doc_id", "nth", "shard", "offset", "n"))
        return out

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id", "nth"), F.lit(self.buckets)).cast("int")

    def _index(self, placed: DataFrame) -> None:
        path = self.path

        def build(group: pa.Table) -> pa.Table:
            seed, n = 0, group.num_rows
            while len(np.unique(hashes := key_hashes(group, seed))) < n:
                seed += 1
            mph = MinimalPerfectHash.build(hashes)
            order = np.argsort(mph.lookup(hashes))
            code = mph.to_bytes()
            columns = [(fingerprints(hashes), "<u4"), (group["shard"].to_numpy(), "<i4"), (group["offset"].to_numpy(), "<i8"), (group["n"].to_numpy(), "<i8")]
            head = np.array([MAGIC, n, len(code), seed], "<i8").tobytes()
            write_once(f"{path}/keys-{group['bucket'][0].as_py():05d}.idx", iter([head, code, *(c[order].astype(kind).tobytes() for c, kind in columns)]))
            return pa.table({"bucket": group["bucket"].slice(0, 1).combine_chunks(), "keys": pa.array([n], pa.int64())})

        written = placed.withColumn("bucket", self._bucket()).groupBy("bucket").applyInArrow(build, "bucket int, keys long")
        written.agg(F.sum("keys")).collect()

    def look_up(self, keys: DataFrame) -> DataFrame:
        """doc_id, nth, shard, offset, n of those distinct keys (doc_id, nth; nth counts the rows of a doc_id from 0, and is 0 where keys lacks it) that the store holds.

        A key that the store does not hold is taken for another with chance 2 ** -32, that of equal fingerprints.
        """
        path = self.path

        def find(group: pa.Table) -> pa.Table:
            store, place = open_store(f"{path}/keys-{group['bucket'][0].as_py():05d}.idx")
            found = pa.table({c: group[c] for c in ("doc_id", "nth")})
            if store.get_file_info(place).type == fs.FileType.NotFound:
                empty = found.slice(0, 0)
                return empty.append_column("shard", pa.array([], pa.int32())).append_column("offset", pa.array([], pa.int64())).append_column("n", pa.array([], pa.int64()))
            with store.open_input_file(place) as f:
                data = f.read()
            _, n, size, seed = (int(x) for x in np.frombuffer(data, "<i8", 4))
            at, columns = 32 + size, []
            for kind in ("<u4", "<i4", "<i8", "<i8"):
                columns.append(np.frombuffer(data, kind, n, at))
                at += columns[-1].nbytes
            hashes = key_hashes(group, seed)
            slot = MinimalPerfectHash.from_bytes(data[32 : 32 + size]).lookup(hashes)
            known = slot >= 0
            known[known] = columns[0][slot[known]] == fingerprints(hashes[known])
            slot, found = slot[known], found.filter(pa.array(known))
            return found.append_column("shard", pa.array(columns[1][slot])).append_column("offset", pa.array(columns[2][slot])).append_column("n", pa.array(columns[3][slot]))

        nth = F.col("nth") if "nth" in keys.columns else F.lit(0)
        distinct = keys.select("doc_id", nth.cast("long").alias("nth")).distinct()
        return distinct.withColumn("bucket", self._bucket()).groupBy("bucket").applyInArrow(find, "doc_id long, nth long, shard int, offset long, n long")

    def read(self, places: DataFrame, *, with_ids: bool = True) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (and ids) of what look_up found, each shard read once in order."""
        path = self.path

        def fetch(group: pa.Table) -> pa.Table:
            group = group.sort_by("offset")
            shard, offsets, sizes = group["shard"][0].as_py(), group["offset"].to_pylist(), group["n"].to_pylist()
            store, place = open_store(f"{path}/ids-{shard:05d}.bin")
            sums, ids = [], []
            with store.open_input_stream(place, buffer_size=1 << 20) if not with_ids else store.open_input_file(place) as f:
                magic, width, *_ = np.frombuffer(f.read(HEADER), "<i4").tolist()
                if magic != MAGIC:
                    raise ValueError(f"{place} is not a payload shard")
                at = 0
                for offset, n in zip(offsets, sizes, strict=True):
                    if offset != at:
                        f.seek(HEADER + offset * width) if with_ids else f.read((offset - at) * width)
                    at = offset + n
                    wide = np.frombuffer(f.read(n * width), f"<u{width}").astype("<u4")
                    if len(wide) != n:
                        raise ValueError(f"{place} ends before its last document")
                    sums.append(zlib.crc32(wide.tobytes()))
                    if with_ids:
                        ids.append(wide.astype(np.int32))
            columns = {"doc_id": group["doc_id"], "shard": group["shard"], "offset": group["offset"], "n_tokens": group["n"], "ids_crc32": pa.array(sums, pa.int64())}
            return pa.table(columns | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

        schema = "doc_id long, shard int, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
        found = places.groupBy("shard").applyInArrow(fetch, schema)
        starts = self.shards.select("shard", F.col("start").alias("first"))
        return found.join(starts, "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, nth: a key for each row of docs (doc_id). Rows are counted by doc_id; a doc_id of very many rows is dealt out in stretches."""
    counted = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("rows")), "token-keys")
    single = counted.where("rows = 1").select("doc_id", F.lit(0).cast("long").alias("nth"))
    many = counted.where("rows > 1").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {STRETCH}"))))
    many = many.repartition("doc_id", "stretch").withColumn("first", F.col("stretch") * STRETCH)
    return single.unionByName(many.select("doc_id", F.explode(F.sequence("first", F.least(F.col("first") + STRETCH, "rows") - 1)).alias("nth")))


def op1(spark, sf_dir: str) -> DataFrame:
    """Write the store of documents and read every document back by its key.

    One row for each row of documents. Null text is an empty document: the end id alone. Rows that repeat a doc_id
    follow one another, ordered by a hash of their text, and each has its own key (doc_id, nth) and comes back; so do
    rows without doc_id, which are stored first. Other columns are not looked at. Empty table: no shards, no rows.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = TokenStore.write(docs, scratch(spark, "tokens"), tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return store.read(store.look_up(row_keys(docs)), with_ids=False)
