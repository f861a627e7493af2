"""Operators whose results a brute-force version gives exactly."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import jaccard, linededup, mixing, token_store, topk
from corpusloom.llm.bpe import decode_documents, encode_documents
from corpusloom.llm.components import components
from corpusloom.llm.cuckoo import CuckooFilter, filter_of
from corpusloom.llm.hashing import MinimalPerfectHash, mix64
from corpusloom.llm.token_store import TokenStore
from corpusloom.runtime import scratch

P = pytest.importorskip("public_tokenizers")


def frame(spark, rows, extra=True):
    """Documents with columns that clash with the operators' own names."""
    names = "doc_id long, text string, source string" + ", size long, n long, shard int, row string, key string" * extra
    return spark.createDataFrame([(*r, *([7, 8, 9, "r", "k"] if extra else [])) for r in rows], names)


def test_minimal_perfect_hash():
    for n in (0, 1, 7, 5000):
        h = mix64(np.arange(n, dtype=np.uint64))
        m = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(h).to_bytes())
        assert sorted(m.lookup(h).tolist()) == list(range(n))


def library_ids(rows):
    """Each row's start and ids (end id included) by the unmodified library, in ascending doc_id order, null first."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, ids))
        start += len(ids)
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("parts", [1, 5])
def test_token_store(spark, monkeypatch, parts):
    monkeypatch.setattr(token_store, "STRETCH", 3)
    path = P.path("word_bpe_49k.json")
    texts = [None, "", "Hello, World. It's 42!", "  naïve Café\n\tÉCOLE ", "x" * 20_000, "İstanbul ẖ H\u0331 Ή", "dogs'. 'tis a--b Straße* ²½", "a\u00a0b\u2003c\x1cd", "E\u0301te\u0301. é,"]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(None, "no key")] * 7 + [(20, "Hello, World. It's 42!")] * 4 + [(None, "no key")]
    docs = frame(spark, [(*r, None) for r in rows]).repartition(parts)
    store = TokenStore.write(docs, scratch(spark, "t"), tokenizer=path, end_id=1)
    keys = token_store.row_keys(docs)
    assert keys.count() == len(rows) and keys.distinct().count() == len(rows)
    absent = spark.createDataFrame([(999, 0), (20, 5), (10, 1)], "doc_id long, nth long")
    found = store.read(store.look_up(keys.unionByName(absent))).collect()
    wanted = library_ids(rows)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids, r.ids_crc32) for r in found) == [(s, d, len(ids), ids, crc(ids)) for d, s, ids in wanted]
    first = store.read(store.look_up(docs.select("doc_id"))).collect()
    assert sorted(r.start for r in first) == sorted({d: s for d, s, _ in reversed(wanted)}.values())


def test_token_store_random_texts():
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, coder, rng = Tokenizer.from_file(path), token_store.WordIds(path, most=5_000), random.Random(11)
    alphabet = list(" \n\tabcXYZ.,'-!#09éÉßñøÜẞςΣİıǅ漢😀\u0301\u0307\u0331\u00a0\x1c\x85½²") + ["<|endoftext|>", "<|STARTOFTEXT|>", " the ", "'re"]
    import pyarrow as pa

    for _ in range(30):
        texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(100)]
        ids, n = coder.encode(pa.array(["skipped", *texts]).slice(1))
        assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
        for got, text in zip(np.split(ids, np.cumsum(n)[:-1]), texts, strict=True):
            assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_op1_as_registered(spark, tmp_path):
    rows = [(3, "One two."), (1, None), (2, "a <|endoftext|> b"), (2, "Second row"), (None, "no id"), (None, "no id"), (7, "word " * 30_000)]
    frame(spark, [(*r, None) for r in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    found = token_store.op1(spark, str(tmp_path)).collect()
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[0])
    either = [[(s, d, len(ids), crc(ids)) for d, s, ids in library_ids(order)] for order in (rows, [*rows[:2], rows[3], rows[2], *rows[4:]])]
    assert got in either


def test_word_ids_refuses_other_files(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.BPE()).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        token_store.WordIds(str(tmp_path / "t.json"))


def test_token_store_added_tokens(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "Hello <|ENDOFTEXT|> World", "<|startoftext|>", "X<|endoftext|>Y<|StartOfText|>z.", "É <|endoftext|>, Ab<|startoftext|>", "<| endoftext |> <|other|>", "<|endoftext|><|endoftext|>. The End"]
    docs = frame(spark, [(i, t, None) for i, t in enumerate(texts)])
    store = TokenStore.write(docs, scratch(spark, "t"), tokenizer=path, end_id=1)
    found = {r.doc_id: r for r in store.read(store.look_up(docs)).collect()}
    start = 0
    for i, t in enumerate(texts):
        wanted = [*library.encode(t, add_special_tokens=False).ids, 1]
        assert (found[i].start, found[i].ids) == (start, wanted)
        start += len(wanted)


def test_token_store_empty(spark):
    docs = frame(spark, [])
    store = TokenStore.write(docs, scratch(spark, "t"), tokenizer=P.path("word_bpe_49k.json"), end_id=1)
    assert store.read(store.look_up(docs)).collect() == []


def test_byte_bpe(spark):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "a  b", "a\n \nb", "x" * 3000, "don't  stop\t\n\n the end "] + ["".join(rng.choices(" \n\tab'sZ1²é漢😀.\x1c\x85\xa0", k=rng.randint(1, 25))) for _ in range(300)]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "null id", None), (3, "a  b", None)]
    encoded = encode_documents(frame(spark, rows), path=path, pattern=P.PATTERN, keep_ids=True)
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        t = "null id" if r.doc_id is None else texts[r.doc_id] or ""
        wanted = library.encode_ordinary(t)
        assert r.ids == wanted and r.n_tokens == len(wanted)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in decode_documents(encoded, path=path, pattern=P.PATTERN).collect()}
    assert back[6].decode() == texts[6]


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(400)]
    rows += [(401, None), (402, []), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, [float("nan")] * 6), (405, [float("inf")] * 6), (406, [1.0, 2.0]), (None, [1.0] * 6), (7, rows[7][1]), (100, rows[100][1])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, score long, cb int")
    got = topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=5).collect()
    clean = [(i, np.floor(np.array(v) * 1024).astype(int)) for i, v in rows if i is not None and i < 401]
    for q in (0, 100, 200, 300):
        v = dict(clean)[q]
        wanted = sorted(((-int(c @ v), i) for i, c in clean if i != q))[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == wanted
    assert topk.exact_top_k(vectors.limit(0), vectors.limit(0)).collect() == []


def test_top_k_over_many_blocks(spark, monkeypatch):
    from corpusloom.llm import blocks

    for name, n in (("CANDIDATES", 90), ("QUERIES", 4), ("LEAST", 20)):
        monkeypatch.setattr(blocks, name, n)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 7)) * np.array([9, 1, 1, 0.1, 0.1, 0.1, 0])
    vectors = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10).toPandas()
    v = np.floor(x * 1024).astype(np.int64)
    for q in range(0, 1500, 100):
        wanted = sorted((-int(c @ v[q]), i) for i, c in enumerate(v) if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in got[got.query_id == q].sort_values("rank").itertuples()] == wanted


def test_no_random_access_stops_early():
    """One heavy dimension: few entries tell the best. Random directions: the lists are read to their ends."""
    rng = np.random.default_rng(6)
    for scale, early in ((np.array([50, 1, 1, 1.0]), True), (np.ones(40), False)):
        x = np.floor(rng.normal(size=(3000, len(scale))) * scale * 1024).astype(np.int64)
        if early:
            x[7, 0] = 60 * 1024
        lists = topk.SortedLists(np.arange(3000), x)
        sample = np.sort(np.delete(x, 7, 0)[:500] @ x[7])[-10]
        q, v, s, read = topk.no_random_access(lists, np.array([7]), x[7:8] / 1024, np.array([sample]), 10)
        wanted = sorted((-int(c @ x[7]), i) for i, c in enumerate(x) if i != 7)[:10]
        assert list(zip((-s).tolist(), v.tolist())) == wanted
        assert (read.max() < 1000) == early and (read.min() > 2000) != early


def test_top_k_comes_from_list_reads(monkeypatch):
    """Bounds hold at every depth, and the scores are sums of entries read: neither vectors nor products are kept."""
    rng = np.random.default_rng(8)
    x = np.floor(rng.normal(size=(700, 9)) * 1024).astype(np.int64)
    x[:, 4] = 5
    lists = topk.SortedLists(np.arange(700), x)
    assert set(vars(lists)) == {"ids", "order", "listed", "depths"}
    for w in (x[3], -x[5], np.zeros(9, np.int64), np.where(np.arange(9) == 2, 0, x[9])):
        reader = topk.Reader(lists, w, True)
        for depth in lists.depths[:-1]:
            reader.read(depth)
            final = x @ w
            assert (reader.low <= final).all() and (reader.high(slice(None)) >= final).all()
            some = np.array([1, 5, 80])
            assert reader.resolve(some).tolist() == final[some].tolist()
        reader.read(700)
        assert reader.sums.astype(np.int64).tolist() == final.tolist()
    big = topk.Reader(topk.SortedLists(np.arange(2), np.array([[2**40, 3], [-(2**40), 1]])), np.array([2**20, 1]), True)
    big.read(2)
    assert big.sums.tolist() == [2**60 + 3, -(2**60) + 1]


def test_vectors_of_several_lengths(spark):
    from corpusloom.llm import mih

    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=2 if i % 3 else 3).tolist()) for i in range(200)] + [(5, rng.normal(size=3).tolist()), (900, [1.0] * 4), (50, [0.5] * 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 50 = 0 or vec_id = 900")
    for found, exact, score in ((topk.exact_top_k(vectors, asked, k=4), True, lambda q, c: int(np.floor(1024 * q) @ np.floor(1024 * c))), (mih.nearest(vectors, asked, k=4), False, lambda q, c: float(q @ c / np.linalg.norm(q) / np.linalg.norm(c)))):
        got = found.collect()
        assert {len(v) for i, v in rows if i in {r.query_id for r in got}} >= {2, 3}
        for q in (0, 100, 150, 50):
            v = np.array(min(e for i, e in rows if i == q))
            wanted = sorted((-score(v, np.array(e)), i) for i, e in rows if i != q and len(e) == len(v))[:4]
            mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
            if exact:
                assert [(-s, i) for _, i, s in mine] == wanted
            else:
                scores = {i: score(v, np.array(e)) for i, e in rows if len(e) == len(v)}
                assert len(mine) == 4 and [s for _, _, s in mine] == pytest.approx([scores[i] for _, i, _ in mine])
        assert not [r for r in got if r.query_id == 900]


def test_one_vec_id_in_many_blocks(spark, monkeypatch):
    from corpusloom.llm import blocks

    for name, n in (("CANDIDATES", 50), ("LEAST", 20)):
        monkeypatch.setattr(blocks, name, n)
    vectors = spark.createDataFrame([(7, [float(i), 1.0]) for i in range(400)] + [(0, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(vectors, vectors.where("vec_id = 0"), k=5).collect()
    assert sorted(((r.rank, r.vec_id, r.score) for r in got)) == [(i + 1, 7, (399 - i) << 20) for i in range(5)]
    assert max(r.entries for r in got) < 100


def test_top_k_refuses_what_does_not_fit():
    with pytest.raises(OverflowError):
        topk.scaled(np.array([[1e300]]))
    with pytest.raises(OverflowError):
        topk.product(np.array([[2**40]]), np.array([[2**40]]))
    assert topk.product(np.array([[2**30, 1]]), np.array([[2**31, 3]])).tolist() == [[2**61 + 3]]


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "  ", " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 60)))]), rng.choice(["b", "a", "a", "a", "é", None, "Z", "empty"])) for i in range(500)]
    rows = [(i, "" if s == "empty" else t, s) for i, t, s in rows] + [(None, "a b", "a"), (3, rows[3][1], rows[3][2])]
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7)).collect()), key=repr)
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    wanted, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in sizes)
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words = {s: n for s, n in mixed.groupBy("source").agg({"doc_id": "count"}).collect()}
    assert set(words) <= set(sizes)
    for r in mixed.collect():
        original = next(t for i, t, _ in rows if i == r.doc_id)
        assert original.startswith(r.text)
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def brute_groups(rows, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, _ in rows:
        w = [x for x in (t or "").translate(low).replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), (least[find(i)] if sets[i] else d) if d is not None else None) for i, (d, *_) in enumerate(rows)]


@pytest.mark.parametrize("block,frequent,few", [(1024, 8, 16), (4, 2, 3), (3, 1000, 2)])
def test_jaccard(spark, monkeypatch, block, frequent, few):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(block)
    bases = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 90))] for _ in range(8)]
    shared = [f"s{i}" for i in range(25)]
    rows = [(900, None, ""), (901, "", ""), (902, " \n", ""), (903, "One two", ""), (904, "one TWO", ""), (None, " ".join(bases[0]), "")]
    for i in range(160):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        if rng.random() < 0.3:
            w = w + shared
        rows.append((i, " ".join(w), ""))
    rows.append(rows[20])
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows), words=4, percent=85).collect()), key=repr)
    # a row without doc_id takes no part in links
    wanted = brute_groups([r for r in rows if r[0] is not None], 4, 85) + [(None, len(set(zip(*[bases[0][i:] for i in range(4)]))), None)]
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("few", [1, 3])
def test_jaccard_of_common_phrases(spark, monkeypatch, few):
    """Documents made of the same phrases: marked, tied by cells, and found linked or not as by brute force."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "HELD", 400)
    rng = random.Random(few)
    phrases = [" ".join(f"p{i}x{j}" for j in range(rng.randint(3, 9))) for i in range(14)]
    rows = []
    for i in range(150):
        chosen = rng.sample(phrases, rng.randint(1, 7))
        rows.append((i, " ".join(chosen), ""))
        if rng.random() < 0.3:
            rows.append((1000 + i, " ".join([*chosen, *rng.sample(["new", "word"], rng.randint(0, 2))]), ""))
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows), words=4, percent=85).collect()))
    assert got == sorted(brute_groups(rows, 4, 85))


@pytest.mark.parametrize("percent", [80, 85])
def test_cells_of_similar_sets_meet(percent):
    rng = np.random.default_rng(percent)
    for n in [1, 2, 3, 5, 7, 12, 13, 20, 40, 100, 700, 4000] * 4:
        base = rng.integers(0, 2**62, n, dtype=np.uint64)
        most = 2 * n * (100 - percent) // (100 + percent)
        for gone in range(0, most + 1, max(1, most // 3)):
            new = rng.integers(0, 2**62, most - gone, dtype=np.uint64)
            other = np.concatenate((base[gone:], new))
            common = n - gone
            if not common or 100 * common < percent * (n + len(new)):
                continue
            a, b = (jaccard.cells(np.sort(x), percent) for x in (base, other))
            assert len(np.intersect1d(a, b))


def test_jaccard_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, text, ""), (2, text + " tail", ""), (3, "w1 w2 w3 w4 w5", "")]
    got = sorted(map(tuple, jaccard.jaccard_components(frame(spark, rows), words=4, percent=85).collect()))
    assert got == [(1, 199_997, 1), (2, 199_998, 1), (3, 2, 3)]


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("few", [0, 50_000])
def test_components(spark, monkeypatch, few):
    import sys

    monkeypatch.setattr(sys.modules["corpusloom.llm.components"], "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(10, 60)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(80)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: c for x, c in least.items() if x != 7}


def brute_lines(rows, least=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(math.inf if d is None else d)
    out = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(key(x)) >= least and len(held[key(x)]) > 1 and min(held[key(x)]) != (math.inf if d is None else d)  # noqa: E731,B023
        kept = [x for x in lines if not gone(x)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows(n=80):
    rng = random.Random(6)
    lines = [" Common Line number %d\t" % i for i in range(12)] + ["common line NUMBER 3", "short", "", "ééééééééé", "éééééééééé", "A" * 5000]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)) + [f"unique line of {i}"] * rng.randint(0, 2)), None) for i in range(n)]
    return rows + [(500, None, None), (501, "", None), (None, "common line number 3\nx", None), (None, "common line number 3", None), rows[4]]


def lines_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_line_dedup(spark):
    rows = line_rows()
    out = linededup.dedup_lines(frame(spark, rows))
    assert lines_of(out) == brute_lines(rows)
    assert {"size", "row", "shard"} <= set(out.columns)
    assert linededup.dedup_lines(frame(spark, [])).collect() == []


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    """Each row is sent its own lines' keys; columns that clash with the operators' own names pass through."""
    import time

    took = []
    for n in (300, 3_000):
        rows = [(i if i % 3 == 0 else 10**6 if i % 3 == 1 else None, "\n".join(f"line {(7 * i + j) % (2 * n)} of many lines" for j in range(20)), "s") for i in range(n)]
        docs = frame(spark, rows).withColumns({"_id": F.lit(5), "_a": F.lit("a"), "_row": F.lit(6)})
        began = time.time()
        out = linededup.dedup_lines(docs)
        assert lines_of(out) == brute_lines(rows)
        took.append(time.time() - began)
        assert {(r["_id"], r["_a"], r["_row"]) for r in out.collect()} == {(5, "a", 6)}
    assert took[1] < 20 + 12 * took[0]


def test_mix_keeps_clashing_columns(spark):
    rows = [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(20)]
    names = ["_size", "_words", "_taken", "_turn", "_id", "_SIZE_"]
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in names})
    plain = sorted((r.doc_id, r.text) for r in mixing.apply_mix(frame(spark, rows, False)).collect())
    got = mixing.apply_mix(docs).collect()
    assert sorted((r.doc_id, r.text) for r in got) == plain and plain
    assert {tuple(r[c] for c in names) for r in got} == {tuple(names)}


def documents_of(rows):
    return list({r[0]: r for r in rows if r[0] is not None and r[0] < 500}.values())


def test_line_index_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PASS", 50)
    rows = documents_of(line_rows())
    first, later, gone = [r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 4 == 1]
    before = linededup.LineIndex.build(frame(spark, first))
    index = before.insert(frame(spark, later))
    assert lines_of(linededup.drop_lines(frame(spark, rows), index.doomed())) == brute_lines(rows)
    assert lines_of(linededup.drop_lines(frame(spark, first), before.doomed())) == brute_lines(first)
    kept = [r for r in rows if r not in gone]
    index = index.delete(frame(spark, gone))
    assert lines_of(linededup.drop_lines(frame(spark, kept), index.doomed())) == brute_lines(kept)
    held = {(r.k1, r.k2) for r in index.references().collect()}
    assert {(r.k1, r.k2) for r in index.known(index.references().select("k1", "k2").distinct()).collect()} == held
    assert sum(r.n for r in index.filters().collect()) == len(held)
    # deleted and inserted anew: as if never gone
    index = index.insert(frame(spark, gone))
    assert lines_of(linededup.drop_lines(frame(spark, rows), index.doomed())) == brute_lines(rows)
    assert index.delete(frame(spark, [(10**6, "never inserted at all", None)])).references().count() == index.references().count()


def test_line_filters_decide(spark):
    """What the filters refuse is never counted, and shards that no line falls into are neither read nor written."""
    rows = [(i, f"a line of {i} alone\nand another of {i}", None) for i in range(400)] + [(1000 + i, "held by three\nand four", None) for i in range(3)]
    index = linededup.LineIndex.build(frame(spark, rows))
    flagged = index.flagged().count()
    assert 1 <= flagged <= 10  # of 801 keys; the rest were new to their filters
    more = index.insert(frame(spark, [(5000, "a line of 7 alone", None)]))
    changed = {s for s in more.versions if more.versions[s] != index.versions[s]}
    assert len(changed) == 1 and {s for s in more.files if more.files[s] != index.files[s]} == changed
    plan = more.references(sorted(changed))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    read = [r.f for r in more.references(sorted(changed)).selectExpr("input_file_name() AS f").distinct().collect()]
    assert read and all(f"/shard={next(iter(changed))}/" in f for f in read)
    assert more.flagged().count() == flagged + 1
    unknown = more.known(frame(spark, [(1, "", None)]).selectExpr("explode(sequence(1, 2000)) AS x").selectExpr("xxhash64(x) AS k1", "bigint(x) AS k2"))
    assert unknown.count() < 20


def test_line_filters_grow(spark, monkeypatch):
    monkeypatch.setattr(linededup.LineIndex, "SHARD_KEYS", 10**9)
    index = linededup.LineIndex.build(frame(spark, [(0, "the first line of all", None)]))
    text = lambda at: "\n".join(f"line number {i} of the corpus" for i in range(at, at + 20_000))
    index = index.insert(frame(spark, [(1, text(0), None)])).insert(frame(spark, [(2, text(10_000), None)]))
    assert index.doomed().count() == 10_000
    assert sum(r.n for r in index.filters().collect()) == 30_001


def test_pour_with_false_positives():
    """Keys that a filter takes for others are found anyway, and inserted."""
    import pyarrow as pa

    class Gullible(CuckooFilter):
        def contains(self, keys):
            return super().contains(keys) | (keys % np.uint64(3) == 0)

    keys = np.concatenate((np.arange(1, 301), np.arange(1, 31), [500, 501])).astype(np.int64)
    refs = np.ones(len(keys), np.int64)
    refs[-1] = 2
    for size in (7, 1000):
        linededup_pass, linededup.PASS = linededup.PASS, size
        f = Gullible(400)
        repeated = linededup.pour(f, pa.table({"k1": keys, "refs": refs, "held": keys == 300}))
        linededup.PASS = linededup_pass
        assert set(keys[repeated]) == {*range(1, 31), 300, 501}
        assert CuckooFilter.contains(f, np.array([x for x in set(keys.tolist()) if x != 300], np.uint64)).all()


def test_cuckoo_filter():
    keys = mix64(np.arange(20_000, dtype=np.uint64))
    f = CuckooFilter.from_bytes(filter_of(keys).to_bytes())
    assert f.contains(keys).all()
    assert f.contains(mix64(np.arange(20_000, 60_000, dtype=np.uint64))).mean() < 0.002
    f.delete(keys[:500])
    assert f.contains(keys[500:]).all() and f.contains(keys[:500]).mean() < 0.01
    f.insert(keys[:500])
    assert f.contains(keys).all()
