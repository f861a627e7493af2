"""Byte-level BPE training over a distributed table of pre-tokens.

The table is never read for one merge. A round takes the commonest pairs as candidates and cuts all words into
segments, the stretches in which every adjacent pair is a candidate; equal segments are added up. A merge that comes
before the first pair left out can only happen within segments, and so can all that it leads to: the parts of a new pair
were as common before. The driver thus learns from a table of segments, whose tokens are bounded by a parameter, as
many merges as the candidates allow (hundreds to all of them), and the words are rewritten once a round. An index from
pair to places and counts kept by differences let a merge touch only the places that hold its pair.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import SPECIAL_TOKENS, TOKENIZER
from corpusloom.runtime import materialize, read_file, ship, write_file

#: Fixed value: the published byte-level pattern. Contractions, letters, digits and other signs, each with a space before it if there is one, then white space, of which the last leaves itself to a word that follows.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: In Java's regular expressions, white space is that of Unicode only with this flag before the pattern.
JAVA = "(?U)"
#: Tokens that the segments of a round may have; candidates of the first round that does not take all pairs, and of any.
SEGMENT_TOKENS, CANDIDATES, MOST_CANDIDATES = 1_000_000, 256, 1 << 17
#: Code points of texts that are encoded together.
TEXT = 4 << 20
#: A pair is one number: the left id above this many bits of the right one.
SHIFT = 21


def pretoken_counts(docs: DataFrame, pattern: str = PRETOKEN) -> DataFrame:
    """piece, n: how often each pre-token occurs. Partial counts are taken before the shuffle."""
    pieces = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(JAVA + pattern), F.lit(0))).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("n"))


def _byte_words(counted: DataFrame) -> DataFrame:
    """ids, n: the byte ids of each pre-token of two bytes or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [p.encode() for p in batch["piece"].to_pylist()]
            flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32) + len(SPECIAL_TOKENS)
            ends = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, flat), batch["n"]], ["ids", "n"])

    return counted.where(F.octet_length("piece") > 1).mapInArrow(run, "ids array<int>, n long")


def _alternate(at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Of the sorted places of pairs that may overlap, those that merge from the left: the first, third ... of a stretch; reach: the place of a pair's right part."""
    nth = np.arange(len(at))
    fresh = np.concatenate([[True], at[1:] != reach[:-1]]) if len(at) else np.zeros(0, bool)
    return at[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0] if len(at) else at


def _apply(flat: np.ndarray, row: np.ndarray, codes: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and their rows (ascending) once the merges are made in the order of their new ids (made, by sorted code).

    In each row the merge of least new id is made wherever its pair stands, from the left, then the next: what making
    one merge after another over all rows comes to, as a pair of a merge never arises again from later ones. A row
    without any pair to merge is left alone from then on.
    """
    none, done = np.iinfo(np.int64).max, []
    while len(flat) and len(codes):
        pairs = (flat[:-1] << SHIFT) + flat[1:]
        at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
        new = np.where((codes[at] == pairs) & (row[:-1] == row[1:]), made[at], none)
        some = np.flatnonzero(new < none)
        if not len(some):
            break
        first = np.flatnonzero(np.diff(row[some], prepend=-1))
        least = np.minimum.reduceat(new[some], first)
        open_rows = row[some[first]]
        some = some[new[some] == np.repeat(least, np.diff(np.append(first, len(some))))]
        some = _alternate(some, some + 1)
        flat = flat.copy()
        flat[some] = new[some]
        left = np.ones(len(flat), bool)
        left[some + 1] = False
        flat, row = flat[left], row[left]
        going = np.zeros(int(row[-1]) + 1, bool)
        going[open_rows] = True
        going = going[row]
        if going.mean() < 0.7:
            done.append((flat[~going], row[~going]))
            flat, row = flat[going], row[going]
    if not done:
        return flat, row
    flat, row = (np.concatenate(x) for x in zip(*done, (flat, row), strict=True))
    order = np.argsort(row, kind="stable")
    return flat[order], row[order]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and the row of each."""
    ids = batch["ids"]
    return ids.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())


def _merge_words(words: DataFrame, merges: list[tuple[int, int]], first_id: int) -> DataFrame:
    """ids, n after the merges, whose new ids count up from first_id, without words that have become one token: they have no pairs any more."""
    codes = np.array([(left << SHIFT) + right for left, right in merges], np.int64)
    order = np.argsort(codes)
    codes, made = codes[order], first_id + order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = _apply(*_flat(batch), codes, made)
            sizes = np.bincount(row, minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(sizes[sizes > 1])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, flat[sizes[row] > 1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, batch["n"].filter(pa.array(sizes > 1))], ["ids", "n"])

    return words.mapInArrow(run, "ids array<int>, n long")


def _pair_counts(words: DataFrame) -> DataFrame:
    """code, n: how often each pair of ids is adjacent. A task sums its batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = _flat(batch)
            inside = row[:-1] == row[1:]
            codes, at = np.unique(((flat[:-1] << SHIFT) + flat[1:])[inside], return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, batch["n"].to_numpy()[row[:-1][inside]])
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "n"])

    return words.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _segments(words: DataFrame, candidates: np.ndarray) -> DataFrame:
    """segment (ids as little-endian 32-bit numbers), n: the stretches of words in which every adjacent pair is one of the sorted candidates, equal ones added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, row = _flat(batch)
            codes = (flat[:-1] << SHIFT) + flat[1:]
            at = np.minimum(np.searchsorted(candidates, codes), len(candidates) - 1)
            joined = (candidates[at] == codes) & (row[:-1] == row[1:])
            starts = np.flatnonzero(np.concatenate([[True], ~joined])) if len(flat) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(flat)))
            long = sizes > 1
            ends = np.concatenate([[0], np.cumsum(sizes[long])]).astype(np.int32)
            data = flat[np.repeat(long, sizes)].astype("<i4")
            segments = pa.Array.from_buffers(pa.binary(), int(long.sum()), [None, pa.py_buffer(ends * 4), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([segments, pa.array(batch["n"].to_numpy()[row[starts[long]]])], ["segment", "n"])

    return words.mapInArrow(run, "segment binary, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def learn(flat: np.ndarray, sizes: np.ndarray, n: np.ndarray, first_id: int, most: int, min_frequency: int, floor: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Merges (left, right) of segments (ids one after another, their sizes, and how often each occurs), the commonest pair first, ties to the smaller pair; new ids count up from first_id.

    At most `most`, none rarer than min_frequency, and none from `floor` on, the (-count, code) of the first pair that
    the segments do not show in full. An index leads from a pair to the places that held it when it arose; counts only
    fall after that, so a pair is looked at anew when it comes to the top with a count that no longer holds.
    """
    token, weight = flat.astype(np.int64), np.repeat(n.astype(np.int64), sizes)
    after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
    ends = np.cumsum(sizes) - 1
    after[ends], before[ends - sizes + 1] = -1, -1
    held = np.flatnonzero(after >= 0)
    codes = (token[held] << SHIFT) + token[after[held]]
    order = np.argsort(codes, kind="stable")
    held, codes = held[order], codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    totals = np.add.reduceat(weight[held], first) if len(first) else np.zeros(0, np.int64)
    upto = np.append(first[1:], len(held))
    enough = totals >= max(1, min_frequency)
    count = dict(zip(codes[first][enough].tolist(), totals[enough].tolist(), strict=True))
    places = dict(zip(codes[first][enough].tolist(), zip(first[enough].tolist(), upto[enough].tolist(), strict=True), strict=True))
    later: dict[int, np.ndarray] = {}
    heap = [(-c, code) for code, c in count.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < most:
        c, code = heapq.heappop(heap)
        now = count.get(code, 0)
        if now != -c:
            if now >= max(1, min_frequency):
                heapq.heappush(heap, (-now, code))
            continue
        if floor is not None and (c, code) >= floor:
            break
        left, right, new = code >> SHIFT, code & ((1 << SHIFT) - 1), first_id + len(merges)
        merges.append((left, right))
        if code in later:
            at = later.pop(code)
        else:
            low, high = places.pop(code)
            at = held[low:high]
        at = at[(token[at] == left) & (after[at] >= 0)]
        at = at[token[after[at]] == right]
        if left == right:
            at = _alternate(at, after[at])
        second = after[at]
        previous, following = before[at], after[second]
        gone = np.unique(np.concatenate([previous[previous >= 0], at, second[following >= 0]]))
        lost, which = np.unique((token[gone] << SHIFT) + token[after[gone]], return_inverse=True)
        less = np.zeros(len(lost), np.int64)
        np.add.at(less, which, weight[gone])
        for pair, by in zip(lost.tolist(), less.tolist(), strict=True):
            if pair in count:
                count[pair] -= by
        token[at], token[second] = new, -1
        after[at] = following
        before[following[following >= 0]] = at[following >= 0]
        previous = before[at]
        fresh = np.unique(np.concatenate([previous[previous >= 0], at[after[at] >= 0]]))
        arisen = (token[fresh] << SHIFT) + token[after[fresh]]
        order = np.argsort(arisen, kind="stable")
        fresh, arisen = fresh[order], arisen[order]
        first = np.flatnonzero(np.diff(arisen, prepend=-1))
        if not len(first):
            continue
        totals = np.add.reduceat(weight[fresh], first)
        upto = np.append(first[1:], len(fresh))
        for i in np.flatnonzero(totals >= max(1, min_frequency)).tolist():
            pair, c = int(arisen[first[i]]), int(totals[i])
            count[pair], later[pair] = c, fresh[first[i] : upto[i]]
            heapq.heappush(heap, (-c, pair))
    return merges


def train_merges(docs: DataFrame, *, vocab_size: int, min_frequency: int, segment_tokens: int = SEGMENT_TOKENS, candidates: int = CANDIDATES) -> list[tuple[int, int]]:
    """Pairs of ids in the order of their merging; new ids follow the special tokens and the 256 bytes.

    The commonest pair first, ties to the smaller pair of ids. All pre-tokens count, whatever their number:
    segment_tokens bounds what the driver holds of them, and with it how many merges a round yields, not which.
    """
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = materialize(_byte_words(pretoken_counts(docs)).repartition(parts), "bpe-words")
    base, merges = len(SPECIAL_TOKENS) + 256, []
    while base + len(merges) < vocab_size:
        held = words.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("t")).first().t
        ranked = _pair_counts(words).where(F.col("n") >= max(1, min_frequency))
        whole = held <= segment_tokens
        if not whole:
            top = ranked.orderBy(F.desc("n"), "code").limit(candidates + 1).toArrow()
            top_codes, top_n = top["code"].to_numpy(), top["n"].to_numpy()
        while True:
            if whole:
                cut, floor = words.select("ids", "n"), None
            else:
                taken = np.sort(top_codes[:candidates])
                floor = (-int(top_n[candidates]), int(top_codes[candidates])) if len(top_codes) > candidates else None
                cut = materialize(_segments(words, taken), "bpe-segments") if len(taken) else None
            size = None if whole or cut is None else cut.agg(F.coalesce(F.sum(F.octet_length("segment")), F.lit(0)).alias("b")).first().b // 4
            if whole or cut is None or size <= segment_tokens or candidates == 1:
                break
            candidates = max(1, candidates // 2)
        if cut is None:
            break
        table = cut.toArrow().combine_chunks()
        if whole:
            lists = table["ids"].combine_chunks()
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        else:
            data = table["segment"].combine_chunks()
            flat, sizes = np.frombuffer(b"".join(data.to_pylist()), "<i4"), pa.compute.binary_length(data).to_numpy() // 4
        found = learn(flat, sizes, table["n"].to_numpy(), base + len(merges), vocab_size - base - len(merges), min_frequency, floor)
        if not found:
            break
        words = materialize(_merge_words(words, found, base + len(merges)), "bpe-words")
        merges += found
        if not whole and 2 * size < segment_tokens:
            candidates = min(candidates * (4 if 16 * size < segment_tokens else 2), MOST_CANDIDATES)
    return merges


def train_bpe(docs: DataFrame, *, vocab_size: int = TOKENIZER.vocab_size, min_frequency: int = TOKENIZER.min_frequency, **bounds: int) -> dict[bytes, int]:
    """Token ids: special tokens, the 256 bytes, then merges by falling count (ties to the smaller pair of ids), as train_merges finds them.

    Null and empty texts teach nothing; pairs rarer than min_frequency are not merged. Two merges that spell the same
    token share the first one's id. bounds: segment_tokens and candidates of train_merges, which change no result.
    """
    token = [b"" for _ in SPECIAL_TOKENS] + [bytes([b]) for b in range(256)]
    vocabulary = {name.encode(): i for i, name in enumerate(SPECIAL_TOKENS)} | {t: i for i, t in enumerate(token) if t}
    for left, right in train_merges(docs, vocab_size=vocab_size, min_frequency=min_frequency, **bounds):
        token.append(token[left] + token[right])
        vocabulary.setdefault(token[-1], len(token) - 1)
    return vocabulary


def save_vocabulary(vocabulary: dict[bytes, int], path: str, *, min_frequency: int, train_bytes: int | None) -> None:
    """The vocabulary as lines of base64 token and id, its figures beside it as JSON; in any file system that Spark knows."""
    lines = [f"{base64.b64encode(t).decode()} {i}\n" for t, i in sorted(vocabulary.items(), key=lambda x: x[1])]
    write_file(path, "".join(lines).encode())
    write_file(f"{path}.meta.json", json.dumps({"vocab_size": len(vocabulary), "min_frequency": min_frequency, "train_bytes": train_bytes or 0}).encode())


def read_vocabulary(path: str) -> dict[bytes, int]:
    """What save_vocabulary wrote."""
    return {base64.b64decode(token): int(i) for token, i in (line.split() for line in read_file(path).decode().splitlines())}


def read_train_bytes(path: str) -> int:
    """train_bytes of a vocabulary's figures; the configured one where they are missing, broken or incomplete."""
    try:
        value = json.loads(read_file(f"{path}.meta.json"))["train_bytes"]
        return value if isinstance(value, int) and not isinstance(value, bool) else TOKENIZER.train_bytes
    except (OSError, ValueError, KeyError, TypeError):
        return TOKENIZER.train_bytes


def merge_piece(piece: bytes, ids: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token: of all adjacent pairs whose union has an id, the one of least id is merged, the leftmost of equal ones, until there is none.

    A heap holds the pairs and tokens know their neighbours, so a piece of n bytes takes n log n steps.
    """
    tokens: list[bytes] = [piece[i : i + 1] for i in range(len(piece))]
    left, right = list(range(-1, len(piece) - 1)), [*range(1, len(piece)), -1]
    heap: list[tuple[int, int, int]] = []

    def offer(a: int, b: int) -> None:
        union = tokens[a] + tokens[b]
        if union in ids:
            heapq.heappush(heap, (ids[union], a, len(union)))

    for i in range(len(piece) - 1):
        offer(i, i + 1)
    while heap:
        found, a, size = heapq.heappop(heap)
        b = right[a]
        # a pair that has changed since it was pushed is another one now
        if not tokens[a] or b < 0 or len(tokens[a]) + len(tokens[b]) != size or ids.get(tokens[a] + tokens[b]) != found:
            continue
        tokens[a], tokens[b] = tokens[a] + tokens[b], b""
        right[a] = after = right[b]
        if after >= 0:
            left[after] = a
            offer(a, after)
        if left[a] >= 0:
            offer(left[a], a)
    return [ids[t] for t in tokens if t]


def unions(ids: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes of all pairs of tokens that spell a token, and its id."""
    found = {(ids[t[:i]] << SHIFT) + ids[t[i:]]: n for t, n in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids}
    codes = np.array(sorted(found), np.int64)
    return codes, np.array([found[c] for c in codes.tolist()], np.int64)


def encode_pieces(pieces: list[bytes], byte_ids: np.ndarray, codes: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pieces one after another, and how many each has: merge_piece of each, all of them at once."""
    flat = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    flat, row = _apply(flat, np.repeat(np.arange(len(pieces)), [len(p) for p in pieces]), codes, made)
    return flat, np.bincount(row, minlength=len(pieces))


def encode_column(ranks: dict[bytes, int]):
    """An Arrow UDF text -> ids of a trained vocabulary, merging by token id; specials never arise from text. About TEXT code points are held at a time; each distinct pre-token among them is merged once."""
    import regex
    from pyspark.sql.types import ArrayType, IntegerType

    usable = {t: i for t, i in ranks.items() if t.decode("utf-8", "replace") not in SPECIAL_TOKENS}
    codes, made = unions(usable)
    byte_ids = np.array([usable[bytes([b])] for b in range(256)], np.int64)

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = regex.compile(PRETOKEN).findall

        def together(texts: list[str]) -> list[np.ndarray]:
            pieces = [split(t) for t in texts]
            known = pa.array([p for own in pieces for p in own], pa.string()).dictionary_encode()
            flat, sizes = encode_pieces([p.encode() for p in known.dictionary.to_pylist()], byte_ids, codes, made)
            which = known.indices.to_numpy()
            lengths, starts = sizes[which], (np.cumsum(sizes) - sizes)[which]
            ends = np.cumsum(lengths)
            at = np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
            upto = np.concatenate([[0], ends])[np.cumsum([len(own) for own in pieces])]
            return np.split(flat[at].astype(np.int32), upto[:-1])

        for batch in batches:
            texts, out, first = [t or "" for t in batch], [], 0
            while first < len(texts):
                size, last = len(texts[first]), first + 1
                while last < len(texts) and size + len(texts[last]) <= TEXT:
                    size, last = size + len(texts[last]), last + 1
                out += together(texts[first:last])
                first = last
            yield pd.Series(out, dtype=object)

    return encode


def decode_column(ranks: dict[bytes, int]):
    """An Arrow UDF ids -> text, special tokens kept."""
    from pyspark.sql.types import StringType

    tokens = {i: t for t, i in ranks.items()}

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if ids is None else b"".join(tokens[int(i)] for i in ids).decode("utf-8", "replace") for ids in batch])

    return decode
