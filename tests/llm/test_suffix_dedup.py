import hashlib
import random
from collections import Counter

import pytest

from corpusloom.llm import suffix_dedup
from corpusloom.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    texts = [None, "", "short", "x" * 300, "ab" * 90, "ab" * 90, passages[0], passages[0]]
    for _ in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        texts.append("".join(parts))
    rows = [(i if i != 7 else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    found = {r.doc_id: tuple(r)[1:] for r in remove_repeats(docs, length=40, passage=9, keep_text=False).collect()}
    wanted = {r[0]: (*a, b) for r, a, b in zip(rows, brute(texts, 40), brute_words(texts, 10), strict=True)}
    assert found == wanted


def brute_words(texts, n):
    """Words covered by runs of n words that also start elsewhere."""
    split = [(t or "").lower().split() for t in texts]  # the texts' letters beside a-z have no other case
    seen = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    return [len({k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}) for w in split]


def test_op2_as_registered(spark):
    """The registered query against brute force over a whole table."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in rows]
    wanted = {r.doc_id: (*a, b) for r, a, b in zip(rows, brute(texts, 400), brute_words(texts, 51), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op2(spark, sf).collect()} == wanted


def test_text_in_pieces(spark, monkeypatch):
    """Texts longer than a piece, copies among them."""
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 50)
    rng = random.Random(8)
    long = "".join(rng.choices("ab ", k=3_000))
    texts = [long, "x" + long[100:2_500], long, None, "b" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: tuple(r)[1:5] for r in remove_repeats(docs, length=40, keep_text=True).collect()}
    assert found == dict(enumerate(brute(texts, 40)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs, length=40).collect() == []


def test_many_copies_of_a_text_take_their_share(spark):
    """Thousands of identical rows, and thousands without doc_id: each is sent its own runs, once."""
    import time

    rng = random.Random(31)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    text, own = words(400), words(90)
    took = []
    for n in (500, 5_000):
        rows = [(7, text)] * (n // 2) + [(None, text)] * (n // 2) + [(1, own), (2, f"{own[:300]} {text[:450]}")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        began = time.time()
        got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(docs, keep_text=False).collect()}
        took.append(time.time() - began)
        size = len(text)
        assert got == {(7, size, size, 1), (None, size, size, 1), (1, len(own), 0, 0), (2, 751, 450, 1)}
    assert took[1] < 10 + 12 * took[0]
