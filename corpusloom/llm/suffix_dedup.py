"""Removal of repeated byte strings by a distributed, sampled suffix array.

A window is a string of `length` symbols, bytes or, to tell of repeated passages, words. Every window has an anchor, the half-length substring in it of least hash
(see anchors), and windows that are equal have it at the same place, so suffixes need sorting only where their anchor
occurs more than once:

1. Anchors are dealt by their leading token, the hash of the anchor's substring. Runs of windows whose anchor is alone
   are unique and go no further; runs that occur whole elsewhere are repeated and done. What is left are edges: runs
   that share the anchor with another run and differ from all others around it.
2. Splitters sampled from the edges' leading tokens range-partition them. A bucket gets the edges' bytes and sorts the
   suffixes at all their windows by multikey quicksort, a quarter window a character; neighbours that agree in all
   characters are repeated. A range holds all suffixes of a leading token, so none has its equal beyond the boundary.
3. A leading token with very many edges is split further, by a hash of the whole window, and equal windows of one task
   are folded into one before they leave it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.anchors import BYTES, SubstringHashes, anchors
from corpusloom.llm.batches import sliced, texts_of
from corpusloom.llm.shingles import Shingler
from corpusloom.runtime import materialize, parts_for, ship

#: Symbols looked at together; a longer text is covered in pieces of four times as many.
TOGETHER = 1 << 20
#: Bytes of the table on disk for which there is one part at least.
TASK_BYTES = 64 << 20
#: Anchors of a task that are resolved among themselves before they are dealt.
HELD = 400_000
#: Edges of one leading token from which it is split.
HOT = 4_096
FULL, EDGE = 1, 2
#: Edges sampled for the splitters, about.
SAMPLE = 10_000


class Bytes:
    """Texts as UTF-8 bytes."""

    kind = np.uint8

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(t.encode(), np.uint8) for t in texts]

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return BYTES[symbols]


class Words(Bytes):
    """Texts as the hashes of their words, A-Z as a-z."""

    kind = np.uint64

    def __init__(self):
        self.shingler = Shingler(1)

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        return self.shingler.word_hashes(texts)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return symbols


def pieces(texts: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of texts: data, first and last place of each piece in it, its text's number and where in the text it starts."""
    part: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def out():
        sizes = np.array([len(x) for *_, x in part], np.int64)
        lasts = np.cumsum(sizes + 1) - 1
        gap = part[0][2][:0].dtype.type(0)
        data = np.concatenate([y for *_, x in part for y in (x, [gap])]).astype(part[0][2].dtype, copy=False)
        return data, lasts - sizes, lasts, np.array([x[0] for x in part], np.int64), np.array([x[1] for x in part], np.int64)

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), 4 * TOGETHER):
            piece = text[at : at + 4 * TOGETHER + length - 1]
            if part and size + len(piece) > TOGETHER:
                yield out()
                part, size = [], 0
            part.append((number, at, piece))
            size += len(piece) + 1
    if part:
        yield out()


def resolve(tokens: np.ndarray, around: np.ndarray, times: np.ndarray) -> np.ndarray:
    """FULL and EDGE bits of each run, from the runs of equal leading token (times: how often a run is known to occur).

    A run that occurs whole more than once is FULL. Where a token has runs that differ, one of each kind is an EDGE.
    """
    order = np.lexsort((around, tokens))
    t, a = tokens[order], around[order]
    new_token = np.concatenate(([True], t[1:] != t[:-1]))
    new_run = new_token | np.concatenate(([True], a[1:] != a[:-1]))
    run, token = np.cumsum(new_run) - 1, np.cumsum(new_token) - 1
    kinds = np.bincount(token[new_run], minlength=token[-1] + 1 if len(token) else 0)
    total = np.bincount(run, times[order])
    flags = np.where(total[run] >= 2, FULL, 0) | np.where(new_run & (kinds[token] >= 2), EDGE, 0)
    out = np.zeros(len(tokens), np.uint8)
    out[order] = flags
    return out


def multikey_sort(characters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by their characters, and for each place in it whether it equals the place before in all of them.

    Rows are split by the first character; only those that share it with a neighbour go on to the next one.
    """
    order = np.argsort(characters[0], kind="stable")
    key = characters[0][order]
    same = np.concatenate(([False], key[1:] == key[:-1]))
    for character in characters[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same[at])
        key = character[order[at]]
        inner = np.lexsort((key, group))
        order[at] = order[at[inner]]
        key = key[inner]
        same[at] = np.concatenate(([False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])))
    return order, same


def packed(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with its part of each column as bytes."""
    order = np.argsort(bucket, kind="stable")
    used, starts = np.unique(bucket[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    cells = {name: pa.array([x[order[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for name, x in columns.items()}
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *cells.values()], ["bucket", *cells])


def unpacked(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in group[name].to_pylist() if x), kind)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row and tag, 128 bits of hash: rows that share them have the same doc_id and text, hence the same repeats."""
    return docs.select("doc_id", "text").withColumns({"row": F.xxhash64("doc_id", "text"), "tag": F.xxhash64(F.lit(1), "text", "doc_id")})


class Repeats:
    """The windows of `length` symbols that also start elsewhere, in the rows (row, tag, text) that numbered() gives."""

    def __init__(self, rows: DataFrame, length: int, symbols: type[Bytes]):
        self.spark, self.length, self.symbols = rows.sparkSession, length, symbols
        ship(self.spark)
        self.rows = rows.select("row", "tag", "text")
        self.buckets = 4 * parts_for(rows, TASK_BYTES)

    def runs(self) -> DataFrame:
        """row, tag, lo, hi, token, flags of the runs of windows that are FULL or EDGE."""
        length, buckets, symbols = self.length, self.buckets, self.symbols

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []

            def dealt() -> pa.RecordBatch:
                row, tag, lo, hi, token, around = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                flags = resolve(token, around, np.ones(len(row), np.int64))
                # one run of each token goes on, with what is known of it; the others are decided and go to buckets below zero
                asks = np.zeros(len(row), bool)
                asks[np.unique(token, return_index=True)[1]] = True
                send = asks | (flags > 0)
                bucket = np.where(asks, ((token >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64), -1 - TaskContext.get().partitionId() % buckets)
                return packed(bucket[send].astype(np.int32), row=row[send], tag=tag[send], lo=lo[send].astype(np.int32), hi=hi[send].astype(np.int32), token=token[send], around=around[send], flags=flags[send])

            from pyspark import TaskContext

            own = symbols()
            for batch in sliced(batches):
                rows, tags = batch["row"].to_numpy(), batch["tag"].to_numpy()
                for data, firsts, lasts, number, offset in pieces(own.symbols(texts_of(batch)), length):
                    text, lo, hi, token, around = anchors(own.values(data), firsts, lasts, length)
                    shift = offset[text] - firsts[text]
                    held.append((rows[number[text]], tags[number[text]], lo + shift, hi + shift, token, around))
                    if sum(len(x[0]) for x in held) > HELD:
                        yield dealt()
            if held:
                yield dealt()

        def settle(group: pa.Table) -> pa.Table:
            row, tag, lo, hi, token, around, flags = (unpacked(group, n, k) for n, k in (("row", np.int64), ("tag", np.int64), ("lo", np.int32), ("hi", np.int32), ("token", np.uint64), ("around", np.uint64), ("flags", np.uint8)))
            if group["bucket"][0].as_py() >= 0:
                flags = flags | resolve(token, around, np.where(flags & FULL, 2, 1))
            keep = flags > 0
            return pa.table({"row": row[keep], "tag": tag[keep], "lo": lo[keep], "hi": hi[keep], "token": token[keep].view(np.int64), "flags": flags[keep].astype(np.int32)})

        blobs = self.rows.mapInArrow(scan, "bucket int, row binary, tag binary, lo binary, hi binary, token binary, around binary, flags binary")
        return blobs.groupBy("bucket").applyInArrow(settle, "row long, tag long, lo int, hi int, token long, flags int")

    def splitters(self, edges: DataFrame) -> np.ndarray:
        """Upper bounds of all buckets but the last, from a bounded sample of leading tokens."""
        share = min(1.0, SAMPLE / max(edges.count(), 1))
        sample = edges.where(F.abs(F.xxhash64("row", "lo") % 1_000_000) < share * 1_000_000).select("token").toArrow()["token"].to_numpy().view(np.uint64)
        return np.unique(np.quantile(sample.astype(np.float64), np.arange(1, self.buckets) / self.buckets).astype(np.uint64)) if len(sample) else np.zeros(0, np.uint64)

    def matches(self, runs: DataFrame) -> DataFrame:
        """row, tag, lo, hi of the windows of edges that occur in another edge."""
        length, buckets, quarter, symbols = self.length, self.buckets, self.length // 4, self.symbols
        edges = runs.where((F.col("flags").bitwiseAND(EDGE)) > 0).select("row", "tag", "lo", "hi", "token")
        splitters = self.splitters(edges)
        hot = materialize(edges.groupBy("token").count().where(F.col("count") >= HOT).select("token", F.lit(True).alias("hot")), "hot-tokens")
        marked = edges.join(hot, "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        # rows of one text share row and tag, and their edges: a set
        listed = marked.groupBy("row", "tag").agg(F.collect_set(F.struct("lo", "hi", "token", "hot")).alias("edges")).select("row", "tag", *[F.col(f"edges.{c}").alias(c) for c in ("lo", "hi", "token", "hot")])
        cuts = [quarter * i for i in range(4)] + [length]

        def tokens_of(hashes: SubstringHashes, starts: np.ndarray) -> list[np.ndarray]:
            return [hashes.of(starts + a, starts + b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

        def windows(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The number of its run and the start of each window."""
            run = np.repeat(np.arange(len(n)), n)
            return run, lo[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = symbols()
            for batch in sliced(batches, most=1 << 20):  # each byte may start a window of a very common run
                cold: list[tuple] = []
                very: list[tuple] = []
                for row, tag, data, lo, hi, token, hot in zip(batch["row"].to_pylist(), batch["tag"].to_pylist(), own.symbols(texts_of(batch)), *(batch[c] for c in ("lo", "hi", "token", "hot")), strict=True):
                    lo, hi, token, hot = (x.values.to_numpy(zero_copy_only=False) for x in (lo, hi, token, hot))
                    cold += [(row, tag, a, b - a + 1, t, data[a : b + length].tobytes()) for a, b, t in zip(lo[~hot].tolist(), hi[~hot].tolist(), token[~hot].tolist(), strict=True)]
                    if hot.any():
                        run, starts = windows(lo[hot].astype(np.int64), (hi - lo + 1)[hot].astype(np.int64))
                        very.append((np.full(len(starts), row, np.int64), np.full(len(starts), tag, np.int64), starts, *tokens_of(SubstringHashes(own.values(data)), starts)))
                for at in range(0, len(cold), 20_000):
                    row, tag, lo, n, token, data = zip(*cold[at : at + 20_000], strict=True)
                    bucket = np.searchsorted(splitters, np.array(token, np.int64).view(np.uint64), "right").astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    batch_out = packed(bucket, row=np.array(row, np.int64), tag=np.array(tag, np.int64), lo=np.array(lo, np.int32), n=np.array(n, np.int32))
                    edge = np.searchsorted(bucket[order], np.array(batch_out["bucket"].to_pylist() + [buckets + 1]))
                    data = pa.array([b"".join(data[i] for i in order[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                    empty = pa.array([b""] * len(data), pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch_out.columns, data, empty, empty], ["bucket", "row", "tag", "lo", "n", "data", "tokens", "times"])
                if very:
                    row, tag, start, *chars = (np.concatenate(x) for x in zip(*very, strict=True))
                    order, same = multikey_sort(chars)
                    fold = np.cumsum(~same) - 1
                    times = np.bincount(fold)[fold]
                    # repeated among themselves: known at once; one of each kind goes on
                    lead = ~same
                    stack = np.stack([c[order] for c in chars], 1)
                    bucket = ((stack[:, 0] ^ stack[:, 2]) >> np.uint64(8)) % np.uint64(buckets)
                    send = lead | (times >= 2)
                    blob = packed(bucket[send].astype(np.int32), row=row[order][send], tag=tag[order][send], lo=start[order][send].astype(np.int32), n=np.ones(int(send.sum()), np.int32), data=np.zeros((int(send.sum()), 0), np.uint8), tokens=stack[send], times=np.where(lead, np.minimum(times, 2), 3)[send].astype(np.uint8))
                    yield blob

        def match(group: pa.Table) -> pa.Table:
            out = []
            cold = group.filter(pc.not_equal(pc.binary_length(group["data"]), 0))
            if cold.num_rows:
                row, tag, lo, n = (unpacked(cold, c, k) for c, k in (("row", np.int64), ("tag", np.int64), ("lo", np.int32), ("n", np.int32)))
                own = symbols()
                data = own.values(unpacked(cold, "data", own.kind))
                sizes = n.astype(np.int64) + length - 1
                first = np.cumsum(sizes) - sizes
                run, starts = windows(first, n.astype(np.int64))
                order, same = multikey_sort(tokens_of(SubstringHashes(data), starts))
                same[:-1] |= same[1:]
                hit = np.zeros(len(starts), bool)
                hit[order[same]] = True
                run, starts = run[hit], starts[hit]
                out.append((row[run], tag[run], lo[run] + (starts - first[run])))
            hot = group.filter(pc.equal(pc.binary_length(group["data"]), 0))
            if hot.num_rows:
                row, tag, lo, times = (unpacked(hot, c, k) for c, k in (("row", np.int64), ("tag", np.int64), ("lo", np.int32), ("times", np.uint8)))
                chars = unpacked(hot, "tokens", np.uint64).reshape(-1, 4)
                order, same = multikey_sort([np.ascontiguousarray(chars[:, i]) for i in range(4)])
                same[:-1] |= same[1:]
                hit = times >= 2
                hit[order[same]] = True
                out.append((row[hit], tag[hit], lo[hit].astype(np.int64)))
            row, tag, at = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((at, tag, row))
            row, tag, at = row[order], tag[order], at[order]
            fresh = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] > at[:-1] + 1)))) if len(row) else np.zeros(0, np.int64)
            last = np.append(fresh[1:], len(row)) - 1 if len(row) else fresh
            return pa.table({"row": row[fresh], "tag": tag[fresh], "lo": at[fresh].astype(np.int32), "hi": at[last].astype(np.int32)})

        blobs = self.rows.join(listed, ["row", "tag"]).mapInArrow(scan, "bucket int, row binary, tag binary, lo binary, n binary, data binary, tokens binary, times binary")
        return blobs.groupBy("bucket").applyInArrow(match, "row long, tag long, lo int, hi int")

    def spans(self) -> DataFrame:
        """row, tag, lo, hi: first and last start of runs of repeated windows; runs may overlap."""
        runs = materialize(self.runs(), "repeat-runs")
        found = materialize(self.matches(runs), "repeat-matches")
        return runs.where((F.col("flags").bitwiseAND(FULL)) > 0).select("row", "tag", "lo", "hi").unionByName(found)


def joined(lo: np.ndarray, hi: np.ndarray, length: int) -> list[list[int]]:
    """The maximal runs that windows starting at lo..hi cover, in order."""
    order, runs = np.argsort(lo), []
    for a, b in zip(lo[order].tolist(), (hi[order] + length).tolist(), strict=True):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def remove_repeats(docs: DataFrame, *, length: int = 400, passage: int | None = None, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words (and kept, the bytes that stay) of each row of docs (doc_id, text; other columns are not looked at).

    Each byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another, goes;
    overlaps count, and strings are judged on the input. With `passage`, a second search over words tells of shorter
    passages, which stay: n_repeated_words counts the words covered by runs of over `passage` words that also start
    elsewhere, A-Z as a-z and any white space alike; without it, the search is left out and the number is null.
    Null text counts as empty; texts shorter than `length` keep all. Null doc_id passes through. Repeated rows repeat
    each other's strings. There are no ties. Very long texts are covered in pieces that overlap. Empty table: no rows.
    """
    rows = numbered(docs)
    found = Repeats(rows, length, Bytes).spans().withColumn("words", F.lit(False))
    if passage is not None:
        found = found.unionByName(Repeats(rows, passage + 1, Words).spans().withColumn("words", F.lit(True)))
    # rows of one text share row and tag, and their runs: a set
    spans = found.groupBy("row", "tag").agg(F.collect_set(F.struct("words", "lo", "hi")).alias("s")).select("row", "tag", *[F.col(f"s.{c}").alias(c) for c in ("words", "lo", "hi")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, words, lo, hi in zip(texts_of(batch), batch["words"], batch["lo"], batch["hi"], strict=True):
                data, runs, told = text.encode(), [], None if passage is None else 0
                if lo.is_valid:
                    lo, hi, words = lo.values.to_numpy(), hi.values.to_numpy(), words.values.to_numpy(zero_copy_only=False)
                    runs = joined(lo[~words], hi[~words], length)
                    if passage is not None:
                        told = sum(b - a for a, b in joined(lo[words], hi[words], passage + 1))
                edge = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), told, kept if keep_text else b""))
            n, removed, count, sha, told, kept = (list(x) for x in zip(*out, strict=True))
            columns = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(sha, pa.string()), pa.array(told, pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_text, names + ["kept"] * keep_text)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long" + ", kept binary" * keep_text
    return rows.join(spans, ["row", "tag"], "left").select("doc_id", "text", "words", "lo", "hi").mapInArrow(cut, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    """remove_repeats over documents, 400 bytes, without the bytes that stay, and with passages of over 50 words told. Nulls, empty and very long texts and repeated rows as there; other columns are not looked at."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passage=50, keep_text=False)
