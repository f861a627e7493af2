"""Importance resampling against a plain version of its definition."""

import hashlib
import math
import random
import re
import zlib

from corpusloom.llm import resampling


def brute(docs, target, percent=5, least=20, seed=42):
    def features(text):
        low = (text or "").translate(str.maketrans(resampling.UPPER, resampling.LOWER))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    bucket = lambda run: zlib.crc32(run.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for rows, into in (([text for _, text in docs], s), (target, t)):
        for text in rows:
            for run in features(text)[1]:
                into[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        words, runs = features(text)
        weight = sum(gain[bucket(r)] for r in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(spark, docs, target, **more):
    rows = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, rank string, n_words int")
    found = resampling.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), **more)
    return sorted((tuple(r) for r in found.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["Der", "die", "élan", "ÉLAN", "x1", "x2", "日本", "zu", "A", "a", "Ω", "end"]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", ".", "\n", "\x00!"]) for _ in range(n)]


def test_rows_equal_the_definition(spark):
    docs = [*enumerate(corpus(300, 1)), (900, None), (901, ""), (902, " .,"), (None, corpus(1, 2)[0]), (903, "ab " * 5000)]
    target = [*corpus(20, 3)[:10], "x1 x2 " * 20, None, ""]
    assert resampled(spark, docs, target) == brute(docs, target)
    assert resampled(spark, docs, target, percent=100, least_words=0, seed=7) == brute(docs, target, 100, 0, 7)


def test_ties_go_to_the_smaller_id_and_repeated_rows_are_rows(spark):
    text = "one two three four " * 6
    docs = [(i, text) for i in range(40)] + [(5, text)] * 60 + [(None, text)] * 30
    found = resampled(spark, docs, ["one two"], percent=50)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 66))
    assert [r[:4] for r in found] == [r[:4] for r in brute(docs, ["one two"], 50)]
    ranked = sorted((r for r in found if r[4]), key=lambda r: r[4])
    assert [(r[3], r[0]) for r in ranked] == sorted(((r[3], r[0]) for r in ranked), key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def test_empty_tables(spark):
    assert resampled(spark, [], ["a b c"]) == []
    docs = [*enumerate(corpus(50, 4))]
    assert resampled(spark, docs, []) == brute(docs, [])
    assert all(r[4] is None for r in resampled(spark, docs[:5], ["a"], percent=0))


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in resampling.op11(spark, sf).collect()), key=str) == brute(docs, target)
