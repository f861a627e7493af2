"""Periodic runs against the definition, word by word."""

import hashlib
import random
import time
import zlib

import numpy as np

from corpusloom.llm import periodic


def brute(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_row(doc_id, text, plant=True):
    words = [w for w in (text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest(lines), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = []
        while len(words) < rng.choice([0, 5, 30, 120]):
            block = rng.choices("abcd", k=rng.randint(1, 7))
            words += block * rng.choice([1, 1, 2, 4, 5, 9]) + block[: rng.randint(0, len(block))]
        out.append(words)
    return out


def test_runs_of_many_texts_at_once():
    found = texts(400, 1)
    numbered = [np.array([ord(w) - 97 for w in words], np.int32) for words in found]
    assert periodic.find_runs(numbered) == [brute(words) for words in found]
    assert periodic.find_runs([]) == []
    assert periodic.find_runs([np.zeros(0, np.int32)]) == [[]]


def test_a_long_run_is_extended_once():
    began = time.time()
    same = np.zeros(300_000, np.int32)
    period = np.arange(300_000, dtype=np.int32) % 1000
    late = np.concatenate([np.arange(500, dtype=np.int32) + 2000, period])
    assert periodic.find_runs([same, period, late]) == [[(0, 300_000, 1)], [(0, 300_000, 1000)], [(500, 300_000, 1000)]]
    assert time.time() - began < 30


def test_rows_equal_the_definition(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", "\t ", "  "]).join(w)) for i, w in enumerate(texts(150, 2))]
    rows += [(None, "x y " * 10), (507, None), (508, ""), (509, " \n"), (511, "a " * 6), (512, "a " * 5), (507, "a b " * 4), (507, "a b " * 4), (513, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, runs string, n_words int")
    for plant in (False, True):
        got = periodic.periodic_runs(docs, plant=plant).collect()
        expected = [brute_row(i, t, plant) for i, t in rows if i != 513]
        digest = lambda r: (r.doc_id, len(r.runs), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r.runs).encode()).hexdigest(), hashlib.sha256(r.collapsed.encode()).hexdigest())
        assert sorted(map(digest, (r for r in got if r.doc_id != 513)), key=str) == sorted(((r[0], r[1], r[6], r[7]) for r in expected), key=str)
        assert [tuple(map(tuple, r.runs)) for r in got if r.doc_id == 513] == [((0, 20_000, 1),)]
    assert periodic.periodic_runs(docs.limit(0)).collect() == []


def test_the_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    expected = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: tuple(r) for r in periodic.op12(spark, sf).collect()}
    assert len(got) == 200
    assert any(r[1] for r in expected.values())
    assert {i: got[i] for i in expected} == expected
