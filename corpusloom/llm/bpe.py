"""Byte-level BPE encoding and decoding.

Whole pre-tokens that the vocabulary holds are resolved by a minimal perfect hash with the stored token as proof;
the others are merged with a heap of adjacent pairs over a linked list of their bytes. Texts are cut at single spaces
first, so that each distinct word of a slice is split into pre-tokens once; what pre-tokens encode to is remembered, in
a bounded number of bytes. Ids, their decimals and their bytes are then put together by array operations.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.batches import sliced
from corpusloom.llm.hashing import MinimalPerfectHash, hash_bytes
from corpusloom.runtime import ship

#: Patterns whose pre-tokens never reach over a single space between two words.
BY_WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


class ByteBpe:
    """Encoder and decoder for a vocabulary of byte strings with merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 96 << 20):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.by_words = pattern in BY_WORDS
        vocabulary = list(ranks)
        hashes = hash_bytes(vocabulary)
        self.mph = MinimalPerfectHash.build(hashes)
        self.slots: list[bytes] = [b""] * len(vocabulary)
        self.slot_ids = np.zeros(len(vocabulary), np.int32)
        for token, slot in zip(vocabulary, self.mph.lookup(hashes).tolist(), strict=True):
            self.slots[slot], self.slot_ids[slot] = token, ranks[token]
        self.tokens = Spelling({i: t for t, i in ranks.items()})
        self.decimals = Spelling({i: b"%d," % i for i in ranks.values()})
        self.known: dict[str, bytes] = {}
        self.used, self.most = 0, most

    def learn(self, pieces: list[str]) -> None:
        """Put distinct pre-tokens into the memory: the whole ones by the minimal perfect hash, the others merged."""
        data = [p.encode() for p in pieces]
        slots, kept = self.mph.lookup(hash_bytes(data)).tolist(), self.slots
        whole = self.slot_ids
        for piece, raw, slot in zip(pieces, data, slots, strict=True):
            found = whole[slot] if slot >= 0 and kept[slot] == raw else self.merge(raw)
            self.known[piece] = ids = np.array(found, np.int32).tobytes()
            self.used += 170 + len(piece) + len(ids)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        rank, n = self.ranks.get, len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # ranks[i]: of the pair that starts at byte i, -1 if none; a heap entry is out of date unless it says the same
        ranks = [rank(piece[i : i + 2], -1) for i in range(n)]
        ranks[-1] = -1
        heap = [r * n + i for i, r in enumerate(ranks) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if ranks[i] != r:
                continue
            j = after[i]
            part[i] = pair = part[i] + part[j]
            part[j], ranks[j] = None, -1
            after[i] = k = after[j]
            ranks[i] = -1
            if k < n:
                before[k] = i
                ranks[i] = r = rank(pair + part[k], -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + i)
            if (p := before[i]) >= 0:
                ranks[p] = r = rank(part[p] + pair, -1)
                if r >= 0:
                    heapq.heappush(heap, r * n + p)
        return [self.ranks[x] for x in part if x is not None]

    #: White space beside white space, or other than space and line feed, or a space at the end: pre-tokens then depend on more than one word.
    RARE = r"\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    TANGLED = rf"[{RARE}]|[ \n][ \n]| \z"

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has. Null counts as empty."""
        if self.used > self.most:
            self.known, self.used = {}, 0
        texts = pc.fill_null(texts, "")
        tangled = pc.match_substring_regex(texts, self.TANGLED) if self.by_words else pa.array([True] * len(texts), pa.bool_())
        lists = pc.split_pattern(pc.if_else(tangled, "", texts), " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        # a text's first word has no space before it, a tangled text stands as a whole: one more entry for each text
        firsts = pc.if_else(tangled, texts, lists.flatten().take(pa.array(offsets[:-1]))).to_pylist()
        at[offsets[:-1]] = len(words) + np.arange(len(firsts))
        pieces = list(map(self.split, [*(" " + w for w in words), *firsts]))
        flat = list(chain.from_iterable(pieces))
        if new := list(filterfalse(self.known.__contains__, set(flat))):
            self.learn(new)
        found = list(map(self.known.__getitem__, flat))
        ids = np.frombuffer(b"".join(found), np.int32)
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4)))
        edges = upto[np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))))]
        sizes = np.diff(edges)[at]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        return ids[np.repeat(edges[at] - ends[:-1], sizes) + np.arange(ends[-1])], np.diff(ends[offsets])

    def decode(self, ids: list[int]) -> bytes:
        return self.tokens.of(np.array(ids, np.int64))[0].tobytes()


class Spelling:
    """A byte string for each id, to be looked up by array."""

    def __init__(self, by_id: dict[int, bytes]):
        n = max(by_id, default=-1) + 1
        parts = [by_id.get(i, b"") for i in range(n)]
        self.missing = np.array([i not in by_id for i in range(n)], bool)
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of ids one after another, and where each ends."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.missing) or self.missing[ids].any()):
            raise KeyError("an id that the vocabulary lacks")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        place = np.repeat((self.starts[ids] - (ends - sizes)).astype(np.int32), sizes)
        place += np.arange(len(place), dtype=np.int32)
        return self.flat[place], ends


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a vocabulary file (base64 token and rank a line); loaded once a worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def digests(spelling: Spelling, ids: np.ndarray, edges: np.ndarray, cut: int) -> list[str]:
    """SHA-256 of each document's spelled ids, without the last `cut` bytes; edges: where its ids begin and end."""
    data, ends = spelling.of(ids)
    data, ends = memoryview(data), np.concatenate((np.zeros(1, np.int64), ends))[edges].tolist()
    return [hashlib.sha256(data[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode_documents(docs: DataFrame, *, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with keep_ids) of each row of docs.

    docs needs doc_id and text; other columns are not looked at. Null text counts as empty: no tokens, hashes of the
    empty string. Null doc_id and repeated rows pass through, one row out for each row in; there are no ties. Empty
    table: no rows. Very long texts are handled one at a time. The file at path must be on every worker, as the
    libraries are.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for part in sliced(batches, most=2 << 20):
            ids, n = coder.encode(part["text"])
            edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            columns = [part["doc_id"], pa.array(n, pa.int64()), pa.array(digests(coder.decimals, ids, edges, 1), pa.string()), pa.array(digests(coder.tokens, ids, edges, 0), pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(edges.astype(np.int32), ids))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, *, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) of each row of encoded (doc_id, ids); null ids count as none."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([coder.decode(ids.as_py() or []) for ids in batch["ids"]], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def op6(spark, sf_dir: str) -> DataFrame:
    """encode_documents over documents. Nulls, empty and very long texts, repeated rows and empty tables as there; other columns are not looked at."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
