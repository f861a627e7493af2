"""Runs of periodic words: stretches of a text that repeat a block of q words at least four times.

A run of period q and length L >= 4q holds four grid points jq, (j+1)q, (j+2)q, (j+3)q, and any two of them in a row
carry the same word. So for each q only n / q words are looked at: where three neighbouring pairs of grid points agree,
the stretch around them is extended to both sides by comparing chunks of the text with itself q words further on.
A grid point that lies, with the next one, within a run found for a divisor of q is skipped: that run has period q too
and is the stretch that an extension would find again. All texts of a slice are probed together, longest first, so that the texts long
enough for a period are a prefix of the array.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import sliced
from corpusloom.llm.resampling import crc32_sql
from corpusloom.runtime import ship

#: Times that a run repeats its block at the least, and words that it has at the least.
TIMES, SHORTEST = 4, 6
#: Words compared at once at the start of an extension; each further chunk is twice as long, up to the limit.
CHUNK, MOST = 32, 1 << 16


def _agreeing(ids: np.ndarray, at: int, period: int, until: int) -> int:
    """The first place from `at` on, up to `until`, where ids differs from ids `period` further on."""
    size = CHUNK
    while at < until:
        upto = min(at + size, until)
        same = ids[at:upto] == ids[at + period : upto + period]
        if not same.all():
            return at + int(np.argmin(same))
        at, size = upto, min(2 * size, MOST)
    return until


def _agreeing_before(ids: np.ndarray, at: int, period: int, least: int) -> int:
    """The first place of the stretch that ends before `at`, down to `least`, in which ids equals ids `period` further on."""
    size = CHUNK
    while at > least:
        down = max(at - size, least)
        same = ids[down:at] == ids[down + period : at + period]
        if not same.all():
            return at - int(np.argmin(same[::-1]))
        at, size = down, min(2 * size, MOST)
    return least


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, an array of word numbers, its maximal runs (start, length, period) by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # a word of one text never equals one of another
    most = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    ids = np.concatenate([texts[i].astype(np.int64) + k * most for k, i in enumerate(order)]) if len(order) else np.zeros(0, np.int64)
    found: list[tuple[int, int, int]] = []  # start, end in ids, period
    known = np.zeros((0, 3), np.int64)  # the same, as an array
    longest = int(sizes[0]) if len(sizes) else 0
    for period in range(1, longest // TIMES + 1):
        total = int(ends[np.searchsorted(-sizes, -max(TIMES * period, SHORTEST), "right") - 1]) if longest >= max(TIMES * period, SHORTEST) else 0
        grid = ids[:total:period]
        same = grid[1:] == grid[:-1]
        points = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * period if len(same) > 2 else ()
        if not len(points):
            continue
        if len(known) < len(found):
            known = np.array(found, np.int64)
        inside = known[(period % known[:, 2] == 0) & (known[:, 1] - known[:, 0] > period)] if len(known) else known
        if len(inside):
            covered = np.zeros(len(points) + 1, np.int64)
            np.add.at(covered, np.searchsorted(points, inside[:, 0]), 1)
            np.add.at(covered, np.searchsorted(points, inside[:, 1] - period), -1)
            points = points[np.cumsum(covered[:-1]) == 0]
        done = -1
        for point in points.tolist():
            if point < done:  # within the stretch that the last point gave
                continue
            k = int(np.searchsorted(ends, point, "right"))
            low, high = int(starts[k]), int(ends[k])
            stop = _agreeing(ids, point, period, high - period)
            start = _agreeing_before(ids, point, period, low)
            done = stop
            if stop + period - start >= max(TIMES * period, SHORTEST):
                found.append((start, stop + period, period))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in sorted(found, key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(ends, start, "right"))
        out[order[k]].append((start - int(starts[k]), end - start, period))
    return out


def planted(doc_id: int | None, n: int) -> tuple[int, int]:
    """From which word on, and with which period, a document of n words is to repeat itself: a tenth of the ids, told by their crc32. A null id never does; (n, 1) stands for no repeat."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return n, 1
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words no run holds after its first block."""
    out = np.ones(n, bool)
    for start, length, period in runs:
        out[start + period : start + length] = False
    return out


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, plant: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of each row of docs (doc_id, text; other columns are not looked at).

    Words are runs of anything but ASCII white space, numbered from 0. collapsed is the text's words, joined by one
    space, without those that a run holds after its first block. plant: documents whose id says so repeat themselves
    from some word on before runs are looked for. Null and empty texts have no words, no runs and an empty collapsed
    text. Null doc_id and repeated rows pass through, equal texts have equal runs (but for plant), very long texts are
    looked at whole, an empty table gives no rows. One narrow pass: nothing is shuffled.
    """
    ship(docs.sparkSession)
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            split = [(t or "").encode().split() for t in batch["text"].to_pylist()]
            number = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode().indices.to_numpy()
            last = np.cumsum([len(words) for words in split])
            ids = np.split(number, last[:-1])
            for i, doc_id in enumerate(batch["doc_id"].to_pylist() if plant else ()):
                n = len(split[i])
                a, period = planted(doc_id, n)
                if a < n:
                    at = np.arange(n)
                    at[a:] = a + (at[a:] - a) % period
                    split[i], ids[i] = [split[i][j] for j in at.tolist()], ids[i][at]
            found = find_runs(ids)
            texts = []
            for words, runs in zip(split, found, strict=True):
                if runs:
                    words = [words[j] for j in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                texts.append(b" ".join(words).decode())
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found], runs_type)
            sizes = pa.array([len(words) for words in split], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sizes, listed, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def longest(runs: Column) -> Column:
    """The longest of the runs, of equal ones that of smallest start and then period; null if there is none."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    return F.when(F.size(runs) > 0, F.struct((-ranked["before"]).alias("start"), ranked["length"].alias("length"), (-ranked["less"]).alias("period")))


def op12(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of periodic_runs over documents that repeat themselves where their ids say so. Nulls, empty texts, ties, repeated rows and empty tables as there; lang, source and other columns are not looked at."""
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    top = longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = f"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc32_sql("doc_id::VARCHAR")} AS h FROM documents
),
plans AS (
    SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM split
),
placed AS (SELECT doc_id, w, n, a, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(0, n)) AS i FROM plans),
words AS MATERIALIZED (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS x FROM placed),
pairs AS (
    SELECT l.doc_id, l.i, r.i - l.i AS q FROM words l JOIN words r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n
),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
told AS (
    SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS top,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY doc_id
),
kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS collapsed FROM words
    WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.doc_id = words.doc_id AND words.i >= start + period AND words.i < start + length)
    GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period,
    (1000 * top.l // top.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
