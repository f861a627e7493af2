import hashlib
import heapq
import math
import os
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import planning, text
from corpusloom.operators import bpe_training, corpus, dedup, evaluation, overlap, packing, report, runs, sampling
from corpusloom.operators import prefix, seeds
from corpusloom.operators.prefix import with_prefix
from corpusloom.plans import catalogue
from corpusloom.runtime import materialize


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def ids(df, column="doc_id"):
    return sorted(r[column] for r in df.collect())


def test_prefix_sums(spark):
    rng = random.Random(0)
    rows = [(rng.choice("ab"), rng.choice([None, *range(50)]), i, rng.randint(0, 9)) for i in range(400)]
    got = with_prefix(spark.createDataFrame(rows, "g string, o long, tie long, v long"), ["o", "tie"], {"before": F.col("v")}, ["g"]).collect()
    held = {"a": 0, "b": 0}
    for r in sorted(got, key=lambda r: (-1 if r.o is None else r.o, r.tie)):
        assert r.before == held[r.g]
        held[r.g] += r.v
    assert len(got) == 400


def test_budgets(spark):
    d = docs(spark, ["aaaa", "bb", "é", "cccc"])
    assert ids(corpus.byte_budget(d, 0)) == [0] and ids(corpus.byte_budget(d, 5)) == [0, 1] and ids(corpus.byte_budget(d, 6)) == [0, 1] and ids(corpus.byte_budget(d, 7)) == [0, 1, 2]
    assert ids(corpus.skip_then_sample(d, 0, 2)) == [1, 2] and ids(corpus.skip_then_sample(d, 5, 9)) == [2, 3] and ids(corpus.skip_then_sample(d, 99, 2)) == [2, 3]
    assert ids(corpus.head(d, 2)) == [0, 1] and ids(corpus.tail(d, 2)) == [2, 3]
    taken = corpus.ingest(docs(spark, ["x" * 9, "short", "y" * 12, "z" * 9]), min_chars=9, max_docs=2, done=docs(spark, [""], 0))
    assert ids(taken) == [2, 3]


def test_dedup_and_pack(spark):
    d = docs(spark, ["một", "hai", "một", "ba", "hai", "hai.", None, ""])
    assert ids(dedup.exact_dedup(d)) == [0, 1, 3, 5, 6] and ids(dedup.duplicates(d)) == [2, 4, 7]
    row = dedup.pack_stats(d, 0.5, F.coalesce(F.length("text"), F.lit(0))).first()
    assert (row.n_in, row.n_duplicates, row.n_kept) == (8, 3, 5) and row.train_tokens + row.val_tokens == row.n_tokens == 3 + 3 + 2 + 4 + 10
    one, other = (dict(dedup.split_documents(x, 0.5).select("text", "split").collect()) for x in (d, d.orderBy(F.desc("doc_id"))))
    assert one == other


def test_overlap(spark):
    train, held = docs(spark, ["Tiếng Việt", "b", "c" * 200]), docs(spark, ["Tiếng Việt", "x", "x", " "])
    row = overlap.overlap_report(held, train).first()
    assert (row.n_eval, row.n_distinct, row.n_internal, row.n_overlap, row.n_train, row.examples, row.clean) == (3, 2, 1, 1, 3, ["Tiếng Việt"], False)
    for bad, match in ((docs(spark, [" "]), "empty"), (docs(spark, ["x", "x"]), "repeats"), (docs(spark, ["b"]), "CONTAMINATION")):
        with pytest.raises(ValueError, match=match):
            overlap.require_clean(overlap.overlap_report(bad, train))
    overlap.require_clean(overlap.overlap_report(docs(spark, ["new"]), train))


def test_containment_in_blocks(spark, monkeypatch):
    needles = spark.createDataFrame([(i, t) for i, t in enumerate(["cat", "dog sat", "none", ""])], "item_id long, text string")
    d = docs(spark, ["the cat", "a dog sat", "cat dog", None])
    wanted = {0: 2, 1: 1, 2: 0}
    for size in (8 << 20, 4):
        monkeypatch.setattr(seeds, "SEED_BYTES", size)
        got = overlap.contains_hits(needles, d).collect()
        assert {r.item_id: r.hits for r in got} == wanted and {r.n_docs for r in got} == {4}


@pytest.mark.parametrize("size", [8 << 20, 8])
def test_containment_of_all_lengths(spark, monkeypatch, size):
    """Needles of every tier, cut from long and short texts or foreign to them, with a prefix that many share."""
    monkeypatch.setattr(seeds, "SEED_BYTES", size)
    rng = random.Random(12)
    texts = ["".join(rng.choices("abc é漢😀", k=n)).strip() for n in (0, 1, 2, 5, 30, 90, 400, 4_000)] + ["x" * 500]
    texts += ["shared preamble of the prompts: " + "".join(rng.choices("pqr", k=40)) for _ in range(40)] + [texts[6], None]
    needles = ["x", "xx" * 40, "q", "zz", "漢😀"] + [t for t in texts[9:29]]
    for t in texts[4:8]:
        needles += [t[i : i + n] for n in (1, 2, 3, 6, 7, 14, 15, 30, 31, 62, 63, 64, 200) for i in (0, len(t) // 3) if t[i : i + n].strip() == t[i : i + n] != ""]
    needles = sorted(set(needles))
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    held = spark.createDataFrame([(t,) for t in texts], "norm string")
    got = {r.needle: r.hits for r in seeds.containing(asked, held).collect()}
    assert got == {n: c for n in needles if (c := sum(n in (t or "") for t in texts))}


def test_windows_of_a_long_text_in_pieces():
    text = "".join(random.Random(3).choices("abcd", k=2 * seeds.TOGETHER + 777))
    pieces = list(seeds._pieces(["ab", text, ""]))
    assert {i for numbers, _ in pieces for i in numbers} == {0, 1, 2}
    mine = [p for numbers, held in pieces for i, p in zip(numbers, held) if i == 1]
    points = lambda t: __import__("numpy").frombuffer(t.encode("utf-32-le"), "<u4")
    whole = seeds.window_seeds(points(text), [3, 5])
    for k in (3, 5):
        assert set(whole[k].tolist()) == {x for p in mine for x in seeds.window_seeds(points(p), [k])[k].tolist()}


def test_running_over_ranges(spark):
    """One run of most rows, cut into ranges; nulls in order, value and run."""
    rng = random.Random(13)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i if i % 41 else None, rng.choice([None, rng.randint(0, 10**6)]), i) for i in range(600)]
    rows = [r for i, r in enumerate(rows) if r[1] is not None or i < 82]  # at most two null steps
    log = spark.createDataFrame(rows, "run string, step long, loss long, _range long")
    got = prefix.with_running(log, ["step", "_range"], ["run"], {"low": F.col("loss")}, {"at": F.col("_range")}).collect()
    held = {}
    for r in sorted(got, key=lambda r: (-1 if r.step is None else r.step, r["_range"])):
        low, at = held.get(r.run, (None, None))
        assert (r.low, r["at"]) == (low, at)
        held[r.run] = (r.loss if low is None else low if r.loss is None else min(low, r.loss), r["_range"])
    assert len(got) == len(rows)
    assert prefix.with_running(log.limit(0), ["step"], ["run"], {"low": F.col("loss")}, {}).collect() == []


def test_running_tasks_are_counted_by_rows(spark, monkeypatch):
    """However well rows compress, a task sorts TASK_ROWS of them or few more; more tasks and ranges give the same rows."""
    log = spark.range(4_000).select((F.col("id") % 3).alias("run"), F.col("id").alias("step"), F.pmod(F.col("id") * 7919, F.lit(1_000)).alias("loss"))
    rows = []
    for size in (1_000_000, 100):
        monkeypatch.setattr(prefix, "TASK_ROWS", size)
        out = prefix.with_running(log, ["step"], ["run"], {"low": F.col("loss")}, {"at": F.col("step")})
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        rows.append(sorted(map(repr, out.collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 4_000 and len(sizes) > 20 and max(sizes) < 700


def test_ranked_percentiles(spark):
    import numpy as np

    from corpusloom.operators.repetition import ranked_percentiles

    rng = random.Random(17)
    rows = [(g, rng.choice([0.25, rng.random()])) for g, n in ((1, 500), (2, 3), (3, 1), (4, 2)) for _ in range(n)]
    shares = {"low": 0.1, "mid": 0.5, "top": 1.0, "least": 0.0}
    got = {r.g: (r.n_docs, r.low, r.mid, r.top, r.least) for r in ranked_percentiles(spark.createDataFrame(rows, "g long, d double"), "g", "d", shares).collect()}
    for g in (1, 2, 3, 4):
        own = [d for x, d in rows if x == g]
        assert got[g] == pytest.approx((len(own), *(float(np.quantile(own, p)) for p in shares.values())), abs=1e-8)
    assert len(got) == 4


def test_clashing_columns(spark):
    rows = [(i, f"t{i % 5}", i, 2 * i, "k", "r", "x") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _v long, _range long, _KEY string, _r string, _by_0 string")
    got = {r.doc_id: r for r in with_prefix(d, ["doc_id"], {"v": F.lit(3)}, ["_r"]).collect()}
    assert [tuple(got[i]) for i in range(12)] == [(*r, 3 * r[0]) for r in rows]
    kept = sorted(tuple(r) for r in dedup.keep_first(d, F.col("text")).collect())
    assert kept == rows[:5]


def test_require_unseen(spark):
    d = docs(spark, ["one two three", "four", None])
    prompts = lambda *texts: spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "item_id string, text string")
    assert overlap.require_unseen(prompts("five", "three two"), d) == 3
    with pytest.raises(ValueError, match="p1=1, p2=1"):
        overlap.require_unseen(prompts("five", "two", " four "), d)
    with pytest.raises(ValueError, match="no documents"):
        overlap.require_unseen(prompts("five"), d.limit(0))


def test_windows(spark):
    tokens = list(range(23))
    parts, at = [], 0
    for n in (3, 1, 0, 12, 2, 5):
        parts.append(tokens[at : at + n])
        at += n
    d = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "doc_id long, ids array<int>")
    for block in (1, 3, 5, 22, 23):
        got = {r.window_id: (r.x, r.y) for r in packing.train_windows(d, F.col("ids"), block).collect()}
        assert got == {w: (tokens[w * block : w * block + block], tokens[w * block + 1 : w * block + block + 1]) for w in range((len(tokens) - 1) // block)}
    e = spark.createDataFrame([(0, list(range(10, 17))), (1, [5]), (2, []), (3, [1, 2])], "doc_id long, ids array<int>")
    got = [(r.doc_id, r.start, r.x, r.y) for r in packing.eval_windows(e, F.col("ids"), 3).orderBy("doc_id", "start").collect()]
    assert got == [(0, 0, [10, 11, 12], [11, 12, 13]), (0, 3, [13, 14, 15], [14, 15, 16]), (3, 0, [1], [2])]
    assert packing.limited(packing.eval_windows(e, F.col("ids"), 3), 1, 1).count() == 1


def test_permutation_and_positions(spark):
    first, second = ([r.window_id for r in packing.permutation(50, e, spark).orderBy("pos").collect()] for e in (0, 1))
    assert sorted(first) == sorted(second) == list(range(50)) and first != second
    assert sorted(packing.numpy_permutation(50, 0)) == list(range(50))
    rows = packing.positions(spark.range(4, 6).withColumnRenamed("id", "step"), 5, 3).orderBy("pos").collect()
    assert [(r.pos, r.epoch, r["index"]) for r in rows] == [(p, p // 5, p % 5) for p in range(12, 18)]


def logit_rows(spark, values):
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)], "row_id long, token_id int, logit double")


def kept(df):
    return sorted(r.token_id for r in df.collect())


def test_sampling_rules(spark):
    base = logit_rows(spark, [2.0, -2.0, 1.0, 1.0, 0.0])
    context = spark.createDataFrame([(0, 0, 2), (0, 1, 0), (0, 2, 1), (0, 3, 1)], "row_id long, pos int, token_id int")
    got = {r.token_id: r.logit for r in sampling.penalize(base, context, 2.0, block=3).collect()}
    assert got == {0: 1.0, 1: -4.0, 2: 1.0, 3: 1.0, 4: 0.0}
    assert kept(sampling.top_k(base, 2)) == [0, 2, 3] and kept(sampling.top_k(base, 99)) == [0, 1, 2, 3, 4]
    p = [math.exp(x) / sum(map(math.exp, [2, -2, 1, 1, 0])) for x in (2, -2, 1, 1, 0)]
    assert all(math.isclose(r.p, p[r.token_id]) for r in sampling.softmax(base).collect())
    assert kept(sampling.top_p(base, 1e-9)) == [0] and kept(sampling.top_p(base, p[0] + 1e-6)) == [0, 2] and kept(sampling.top_p(base, 1.0)) == [0, 1, 2, 3, 4]
    many = base.drop("row_id").crossJoin(spark.range(4000).withColumnRenamed("id", "row_id"))
    share = sampling.draw(many, 3).where("token_id = 0").count() / 4000
    assert abs(share - p[0]) < 0.04
    with pytest.raises(ValueError):
        sampling.sample(base, context, config.SamplingProfile("x", 0.0, None, None, 1.0), 1)


def test_generation_stops_at_the_end(spark):
    pairs = spark.createDataFrame([(0, 5, 6, 50), (0, 6, 2, 50)], "doc_id long, x int, y int, n long")
    scorer = evaluation.BigramScorer(pairs)
    vocabulary = spark.createDataFrame([(2,), (5,), (6,)], "token_id int")
    context = spark.createDataFrame([(0, 0, 5), (1, 0, 6)], "row_id long, pos int, token_id int")
    sure = config.SamplingProfile("sure", 1.0, 1, None, 1.0)
    out = sampling.generate(context, lambda c: scorer.logits(c, vocabulary), sure, steps=5, eos=2, block=8, seed=1)
    assert {r.row_id: [x.token_id for x in sorted(r.t)] for r in out.groupBy("row_id").agg(F.collect_list(F.struct("pos", "token_id")).alias("t")).collect()} == {0: [5, 6, 2], 1: [6, 2]}


def test_cutting(spark):
    d = spark.createDataFrame([([1, 2, 3],), ([2],), ([5, 6],), ([],)], "t array<int>")
    assert [r.x for r in d.select(text.cut_at_end(F.col("t"), 2).alias("x")).collect()] == [[1], [], [5, 6], []]
    assert [r.x for r in d.select(text.last_block(F.col("t"), 2).alias("x")).collect()] == [[2, 3], [2], [5, 6], []]


def test_losses(spark):
    d = docs(spark, ["a b a b", "a c", "x", None])
    pairs = evaluation.token_pairs(d, text.words(F.col("text")))
    row = evaluation.token_weighted(evaluation.BigramScorer(pairs).cross_entropy(pairs)).first()
    ce = [-math.log((2 + 1) / (3 + 3))] * 2 + [-math.log((1 + 1) / (1 + 3))] + [-math.log((1 + 1) / (3 + 3))]
    assert row.n_tokens == 4 and row.n_docs == 2 and math.isclose(row.nll, sum(ce) / 4, rel_tol=1e-6) and math.isclose(row.perplexity, math.exp(sum(ce) / 4), rel_tol=1e-4)
    empty = evaluation.compression(docs(spark, []), F.length("text"), 2.4).first()
    assert (empty.ratio, empty.n_docs, empty.passes) == (0.0, 0, False)


HELD = [(i, " ".join(f"w{(i * 7 + k * k) % (5 + i % 11)}" for k in range(i % 9))) for i in range(60)] + [(None, "a b a"), (60, None), (70, "only"), (71, "\u3000a\u2003b\x85 b ")]


def test_summed_losses_are_those_of_the_scorer(spark):
    d = spark.createDataFrame(HELD, "doc_id long, text string").withColumn("batch", F.floor(F.col("doc_id") / 20))
    learn, ask, words = F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 0, text.words(F.col("text"))
    pairs = evaluation.token_pairs(d, words, "doc_id", "batch")
    scored = evaluation.BigramScorer(pairs.where(learn)).cross_entropy(pairs.where(ask))
    want, got = evaluation.token_weighted(scored).first(), evaluation.token_weighted(evaluation.held_out_loss(pairs, learn, ask), n_docs=evaluation.targets(d.where(ask), words)).first()
    assert want.n_tokens > 40 and want == got
    shares = evaluation.batch_shares(d.where(ask), words, "batch")
    shared = evaluation.token_pairs(d.join(shares, "batch", "left"), words, "doc_id", "share")
    want, got = evaluation.batch_mean(scored, F.col("batch")).first(), evaluation.mean_of_batches(evaluation.held_out_loss(shared, learn, ask, "share"), shares).first()
    assert want.n_batches == 3 and want == got
    none = evaluation.batch_shares(d.where("false"), words, "batch")
    assert evaluation.mean_of_batches(evaluation.held_out_loss(shared, learn, F.lit(False), "share"), none).first() == (None, 0)


@pytest.mark.parametrize("name", ["validation_loss", "nll_bigram"])
def test_losses_write_and_join_no_table_of_pairs(spark, tmp_path, monkeypatch, name):
    rows = [(i, " ".join(f"w{(i * 31 + k * k) % 40}" for k in range(60)), "s") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    written, plans = [], []

    def recorded(df, table):
        out = materialize(df, table)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        written.append(out.count())
        return out

    monkeypatch.setattr(evaluation, "materialize", recorded)
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    found.collect()
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    n_pairs = len({p for _, t, _ in rows for p in zip(t.split(), t.split()[1:])})
    # at most 40 words and the counts of pairs; before, every pair
    assert n_pairs > 400 and max(written) < 200
    assert not any("Join" in line and re.search(r"\b[xy]#", line) for plan in plans for line in plan.split("\n"))


def test_plans(spark):
    n = spark.range(1).select(planning.parameters(F.lit(32_000), F.lit(1024), F.lit(12), F.lit(768)).alias("n")).first().n
    assert n == 110_316_288 and spark.range(1).select(planning.format_params(F.lit(n)).alias("s")).first().s == "110.3M"
    vram = spark.range(1).select(planning.vram_gb(F.lit(n), F.lit(8), F.lit(1024), F.lit(12), F.lit(768)).alias("g")).first().g
    assert abs(vram - 6.91) < 0.15 * 6.91
    steps = config.TRAIN.target_tokens // planning.tokens_per_step(config.TRAIN, config.MODEL)
    assert steps == 33_569
    rates = spark.range(steps + 5).select(planning.learning_rate(F.col("id"), steps, config.TRAIN).alias("lr"))
    assert abs(rates.limit(steps).agg(F.sum("lr")).first()[0] - 11.01834) < 1e-3
    assert rates.agg(F.min("lr"), F.max("lr")).first()[1] <= config.TRAIN.lr


def test_runs(spark):
    inf = float("inf")
    log = spark.createDataFrame([(s, t, 1, 2, 0.123456, b, 0.1, 1234.6, 1.005) for s, t, b in ((100, 1000, inf), (200, 0, 0.55555))], "step long, total_steps long, tokens_seen long, data_position long, loss double, best_val_loss double, lr double, tokens_per_second double, vram_gb double")
    a, b = runs.progress_rows(log).orderBy("step").collect()
    assert (a.progress, a.best_val_loss, a.loss, a.tokens_per_second) == (0.1, None, 0.1235, 1235) and (b.progress, b.best_val_loss) == (0.0, 0.5556)
    rows = [("r", s, v) for s, v in ((200, 3.0), (400, 1.0), (600, 2.0), (800, 2.0), (1000, None))]
    catalog = spark.createDataFrame(rows, "run string, step long, loss double")
    assert ids(runs.retained(catalog, ["run"], 2, "loss"), "step") == [400, 800, 1000]
    best = {r.step: r.is_best for r in runs.running_best(catalog.where("loss is not null"), ["run"], ["step"], "loss").collect()}
    assert best == {200: True, 400: True, 600: False, 800: False}
    assert runs.latest_loadable(catalog, ["run"], F.col("loss").isNotNull()).first().step == 800
    assert runs.upsert(catalog, spark.createDataFrame([("r", 400, 9.0)], catalog.schema)).where("step = 400").first().loss == 9.0
    files = spark.createDataFrame([("step_0000400.pt",), ("best.pt",)], "file string")
    assert ids(runs.rebuild(files), "step") == [400]


def test_bpe_training(spark, tmp_path):
    d = docs(spark, ["abab abab abab", "xab é😀\t\n", "", None, "漢字 <bos> 's"])
    ranks = bpe_training.train_bpe(d, vocab_size=270)
    assert [ranks[s.encode()] for s in config.SPECIAL_TOKENS] == [0, 1, 2] and all(bytes([b]) in ranks for b in range(256))
    assert ranks[b"ab"] == 259 and len(set(ranks.values())) == len(ranks) <= 270
    encode, decode = bpe_training.encode_column(ranks), bpe_training.decode_column(ranks)
    for r in d.select("text", encode("text").alias("t")).select("text", "t", decode("t").alias("back")).collect():
        assert r.back == (r.text or "") and all(i > 2 for i in r.t)
    path = str(tmp_path / "v")
    bpe_training.save_vocabulary(ranks, path, min_frequency=2, train_bytes=None)
    assert bpe_training.read_train_bytes(path) == 0 and bpe_training.read_train_bytes(path + "x") == config.TOKENIZER.train_bytes
    (tmp_path / "v.meta.json").write_text("{broken")
    assert bpe_training.read_train_bytes(path) == config.TOKENIZER.train_bytes


def brute_bpe(counts, vocab_size, min_frequency=2):
    """Merges (left, right) by counting all pairs anew for each."""
    words = {tuple(b + len(config.SPECIAL_TOKENS) for b in p.encode()): n for p, n in counts.items()}
    merges = []
    for new in range(256 + len(config.SPECIAL_TOKENS), vocab_size):
        pairs = Counter()
        for word, n in words.items():
            for pair in zip(word, word[1:]):
                pairs[pair] += n
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < min_frequency:
            break
        merges.append(best)
        after = Counter()
        for word, n in words.items():
            out, at = [], 0
            while at < len(word):
                met = word[at : at + 2] == best
                out.append(new if met else word[at])
                at += 1 + met
            after[tuple(out)] += n
        words = after
    return merges


def quick_bpe(counts, vocab_size, min_frequency=2):
    """As brute_bpe, but only the words that hold the merged pair are counted anew."""
    words = [([b + len(config.SPECIAL_TOKENS) for b in p.encode()], n) for p, n in counts.items()]
    pairs, where, heap, merges = Counter(), {}, [], []
    for i, (word, n) in enumerate(words):
        for pair in zip(word, word[1:]):
            pairs[pair] += n
            where.setdefault(pair, set()).add(i)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    while heap and 256 + len(config.SPECIAL_TOKENS) + len(merges) < vocab_size:
        n, best = heapq.heappop(heap)
        if -n != pairs[best]:
            continue
        if -n < min_frequency:
            break
        new, touched = 256 + len(config.SPECIAL_TOKENS) + len(merges), set()
        merges.append(best)
        for i in where.pop(best):
            word, n = words[i]
            out, at = [], 0
            while at < len(word):
                met = tuple(word[at : at + 2]) == best
                out.append(new if met else word[at])
                at += 1 + met
            for pair in zip(word, word[1:]):
                pairs[pair] -= n
                touched.add(pair)
            for pair in zip(out, out[1:]):
                pairs[pair] += n
                touched.add(pair)
                where.setdefault(pair, set()).add(i)
            words[i] = (out, n)
        for pair in touched:
            heapq.heappush(heap, (-pairs[pair], pair))
    return merges


def brute_ranks(counts, vocab_size, trainer=None):
    token = [b""] * len(config.SPECIAL_TOKENS) + [bytes([b]) for b in range(256)]
    ranks = {t: i for i, t in enumerate(token) if t}
    for left, right in (trainer or brute_bpe)(counts, vocab_size):
        token.append(token[left] + token[right])
        ranks.setdefault(token[-1], len(token) - 1)
    return ranks | {s.encode(): i for i, s in enumerate(config.SPECIAL_TOKENS)}


def test_bpe_training_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aab", k=rng.randint(1, 9))) for _ in range(60)) for _ in range(20)] + ["aaa aaaa aaaaa " * 9, "abab ababab é漢😀", None]
    counts = Counter(p for t in texts for p in regex.findall(bpe_training.PRETOKEN, t or ""))
    assert bpe_training.train_bpe(docs(spark, texts), vocab_size=330) == brute_ranks(counts, 330)
    assert bpe_training.train_bpe(docs(spark, texts), vocab_size=2_000) == brute_ranks(counts, 2_000)  # until pairs are too rare
    assert len(bpe_training.train_bpe(docs(spark, [None, "", "a"]), vocab_size=330)) == 256 + len(config.SPECIAL_TOKENS)


def random_words(rng, n, letters, longest):
    return ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)]


def test_bpe_rounds_change_no_merge(spark):
    """Few candidates and small segments make many rounds; the merges are those of one over all words."""
    rng = random.Random(11)
    for letters, n in (("ab", 200), ("aabc", 400), ("abcdefgh", 900)):
        texts = [" ".join(random_words(rng, n, letters, 12)), "a" * 50 + " " + "ab" * 30 + "  \n\n x"]
        counts = Counter(p for t in texts for p in regex.findall(bpe_training.PRETOKEN, t))
        wanted = quick_bpe(counts, 700)
        assert wanted == brute_bpe(counts, 700)
        d = docs(spark, texts)
        assert bpe_training.train_merges(d, vocab_size=700, min_frequency=2) == wanted
        for tokens, candidates in ((300, 16), (60, 4)) if letters != "abcdefgh" else ((600, 64),):
            cap = 256 + len(config.SPECIAL_TOKENS) + (60 if tokens == 60 else 441)
            assert bpe_training.train_merges(d, vocab_size=cap, min_frequency=2, segment_tokens=tokens, candidates=candidates) == wanted[: cap - 259]


def test_published_pretokens(spark):
    texts = ["a  b", "x\n\n y", "  lead", "trail   ", "it's  'll 12a", "\u00a0\u00a0w \u3000z", "\t\tq"]
    found = {(r.piece, r.n) for r in bpe_training.pretoken_counts(docs(spark, texts)).collect()}
    assert found == set(Counter(p for t in texts for p in regex.findall(bpe_training.PRETOKEN, t)).items())
    assert regex.findall(bpe_training.PRETOKEN, "x\n\n  y") == ["x", "\n\n ", " y"]


def test_vocabulary_files(spark, tmp_path):
    ranks = bpe_training.train_bpe(docs(spark, ["abab abab \u00e9\u00e9 \u00e9\u00e9"]), vocab_size=262)
    path = f"file://{tmp_path}/deep/v"
    for size in (7, 9):  # written over
        bpe_training.save_vocabulary(ranks, path, min_frequency=2, train_bytes=size)
        assert bpe_training.read_vocabulary(path) == ranks and bpe_training.read_train_bytes(path) == size
    assert sorted(x for x in os.listdir(tmp_path / "deep") if not x.endswith(".crc")) == ["v", "v.meta.json"]


def test_bpe_queries_train_on_all_pretokens(spark, tmp_path):
    """6,000 pre-tokens that come twice, and 5,000 that come once and alone hold the commonest pair."""
    rng = random.Random(6)
    common = list({"".join(rng.choices("abcdefgh", k=7)) for _ in range(6_100)})[:6_000]
    rare = [f"{w}qzqz" for w in common[:5_000]]
    texts = [" ".join(common[i::50] * 2 + rare[i::50]) for i in range(50)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter(p for t in texts for p in regex.findall(bpe_training.PRETOKEN, t))
    ranks = brute_ranks(counts, config.TOKENIZER.vocab_size, quick_bpe)

    def length(piece):
        parts = [bytes([b]) for b in piece.encode()]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    assert len(ranks) > 10_000
    sizes = {p: length(p) for p in counts}
    wanted = {i: 2 + sum(sizes[p] for p in regex.findall(bpe_training.PRETOKEN, t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in catalogue.bpe_encode_lengths(spark, str(tmp_path)).collect()} == wanted
    back = {r.doc_id: (r.decoded_md5, r.n_bytes) for r in catalogue.bpe_round_trip(spark, str(tmp_path)).collect()}
    assert back == {i: (hashlib.md5(t.encode()).hexdigest(), len(t)) for i, t in enumerate(texts)}


def test_release_report(spark, tmp_path):
    import json

    summary = {k: 1.0 for k in report.GENERATION}
    result = {k: 2.0 for k in report.LOSS}
    gen = {"purpose": "final", "eligible_for_final_claims": True, "used_for_sampling_tuning": False, "contamination": {"exact_prompt_hits": 0}, "run": {"checkpoint_step": 5, "checkpoint_fingerprint": "c", "tokenizer_fingerprint": "t"}, "summary": summary}
    loss = {"purpose": "final_human_loss", "eligible_for_final_claims": True, "checkpoint_step": 5, "checkpoint_fingerprint": "c", "tokenizer_fingerprint": "t", "separation": {"n_overlap": 0}, "result": result}

    def build(g, r):
        (tmp_path / "gen_1.json").write_text(json.dumps(g))
        (tmp_path / "loss_1.json").write_text(json.dumps(r))
        a, b = (report.read_artifact(spark, report.only_file(str(tmp_path), f"{n}_*.json")) for n in ("gen", "loss"))
        return report.release_report(a, b, step=5, checkpoint="c")

    row = build(gen, loss).first()
    assert row.nll == 2.0 and "| nll | 2.0 |" in report.render_markdown(row)
    for g, r, gate in ((gen | {"used_for_sampling_tuning": True}, loss, "tuning"), (gen, loss | {"tokenizer_fingerprint": "x"}, "tokenizer"), (gen, loss | {"checkpoint_step": 6}, "checkpoint"), (gen, loss | {"separation": {"n_overlap": 1}}, "held-out"), (gen, loss | {"result": result | {"nll": "x"}}, "loss has nll")):
        with pytest.raises(ValueError, match=gate):
            build(g, r)
    (tmp_path / "gen_2.json").write_text("{}")
    with pytest.raises(ValueError):
        report.only_file(str(tmp_path), "gen_*.json")


def test_guards(tmp_path):
    with pytest.raises(ValueError):
        report.require_outside(str(tmp_path / "a"), str(tmp_path / "a"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        report.require_outside(str(tmp_path / "a"), str(tmp_path / "c" / "x"), str(tmp_path / "c"))
    report.require_outside(str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c"))
    with pytest.raises(ValueError):
        report.require_provenance(True, author="me", licence=" ")
    with pytest.raises(ValueError):
        report.require_provenance(False, author="me")
    assert report.require_match("tokenizer", "f", None, "f") == 1
    with pytest.raises(ValueError):
        report.require_match("tokenizer", "f", "g", "f")
    with pytest.raises(FileExistsError):
        report.require_new(str(tmp_path))


def test_keep_first_without_order(spark):
    rows = [(None, "alone"), (None, "alone"), (None, "shared"), (3, "shared"), (5, "shared"), (7, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, dedup.exact_dedup(docs).collect()), key=repr)
    assert kept == sorted([(None, "alone"), (3, "shared"), (7, None)], key=repr)


def test_containment_counts(spark):
    rng = random.Random(4)
    docs = ["".join(rng.choices("ab é\n", k=rng.randint(0, 60))) for _ in range(80)]
    needles = ["a", "ab", "b é", "abab", "zz", "ab", "é\n", " "]
    import unicodedata

    norm = lambda t: __import__("re").sub("\n{3,}", "\n\n", unicodedata.normalize("NFC", t)).strip()
    asked = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    corpus_ = spark.createDataFrame([(i, t) for i, t in enumerate([*docs, None])], "doc_id long, text string")
    got = {r.item_id: (r.hits, r.n_docs) for r in overlap.contains_hits(asked, corpus_).collect()}
    assert got == {i: (sum(norm(n) in norm(d) for d in docs), 81) for i, n in enumerate(needles) if norm(n)}
    assert overlap.contains_hits(asked.limit(0), corpus_).collect() == []


def test_joined_ngrams(spark):
    from corpusloom.functions.text import distinct_n, joined_ngrams

    frame = spark.createDataFrame([(["a", "b", "a", "b"],), ([],), (["x"],)], "w array<string>")
    assert [r.g for r in frame.select(joined_ngrams(F.col("w"), 2).alias("g")).collect()] == [["a b", "b a", "a b"], [], []]
    assert [r.d for r in frame.select(distinct_n(F.col("w"), 2).alias("d")).collect()] == [2 / 3, 0.0, 0.0]


def test_raw_token_files(spark, tmp_path):
    from corpusloom.sources import tokens

    docs = spark.createDataFrame([(i, [i, 60_000, 7] if i % 3 else None) for i in range(50)] + [(50, [])], "doc_id long, ids array<int>")
    files = tokens.write_raw(docs, f"{tmp_path}/raw", 65_535)
    wanted = [x for i in range(50) if i % 3 for x in (i, 60_000, 7)]
    assert sum(f.n for f in files.collect()) == len(wanted)
    rows = sorted(map(tuple, tokens.read_raw(spark, f"{tmp_path}/raw", 2, chunk=10).collect()))
    assert [x for *_, ids in rows for x in ids] == wanted and max(len(ids) for *_, ids in rows) == 10
    with pytest.raises(Exception, match="outside"):
        tokens.write_raw(docs, f"{tmp_path}/low", 100)
    assert not list((tmp_path / "low").glob("*.bin"))


def test_shard_numbers_with_nulls(spark):
    from corpusloom.sources import jsonl

    rows = [("a", 1, "xxxx"), ("a", 2, "xx"), ("a", 3, "x"), ("a", 3, "y"), ("a", None, "first"), (None, 1, "xxxxxx"), (None, 2, "x"), (None, None, None)]
    got = jsonl.shard_numbers(spark.createDataFrame(rows, "source string, doc_id long, text string"), "source", "doc_id", shard_bytes=5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([("a", None, "first", 0), ("a", 1, "xxxx", 1), ("a", 2, "xx", 1), ("a", 3, "x", 2), ("a", 3, "y", 2), (None, None, None, 0), (None, 1, "xxxxxx", 0), (None, 2, "x", 1)], key=repr)


def test_merge_piece_against_rescanning():
    rng = random.Random(9)
    for _ in range(300):
        ids = {bytes([b]): b for b in b"abc"}
        for n in range(rng.randint(0, 25)):
            a, b = rng.choice(list(ids)), rng.choice(list(ids))
            ids.setdefault(a + b, 300 + n)
        piece = bytes(rng.choices(b"abc", k=rng.randint(1, 40)))
        parts = [bytes([b]) for b in piece]
        while pairs := [(ids[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ids]:
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert bpe_training.merge_piece(piece, ids) == [ids[p] for p in parts]
        byte_ids = __import__("numpy").arange(256)
        flat, sizes = bpe_training.encode_pieces([piece, b"", piece[:3], piece], byte_ids, *bpe_training.unions(ids))
        assert flat.tolist() == [ids[p] for p in parts] + bpe_training.merge_piece(piece[:3], ids) + [ids[p] for p in parts]
        assert sizes.tolist() == [len(parts), 0, len(bpe_training.merge_piece(piece[:3], ids)), len(parts)]
    assert bpe_training.merge_piece(b"", {}) == [] and len(bpe_training.merge_piece(b"ab" * 200_000, {b"a": 0, b"b": 1, b"ab": 2})) == 200_000


def test_held_out_source_is_many_files(spark):
    """The source is written by as many tasks as read it, and counts as one."""
    from pathlib import Path

    from corpusloom.plans import catalogue
    from corpusloom.runtime import shared_dir

    root, setting = Path(shared_dir(spark).removeprefix("file:")), "spark.sql.files.maxPartitionBytes"
    before, there = spark.conf.get(setting), set(root.iterdir())
    spark.conf.set(setting, "64k")
    try:
        row = catalogue.held_out_set(spark, "/root/testdata/sf0.001").first()
    finally:
        spark.conf.set(setting, before)
    (source,) = [p for p in set(root.iterdir()) - there if p.name.endswith("-source")]
    assert row.sources == 1 and row.docs == 20 and len(list(source.glob("part-*.txt"))) > 1


def test_range_of_bounds(spark):
    from corpusloom.operators.prefix import _range_of

    for n in (0, 1, 2, 3, 10, 57):
        bounds = [float(3 * i) for i in range(n)]
        got = spark.range(-2, 3 * n + 3).select("id", _range_of(F.col("id").cast("double"), bounds).alias("r")).collect()
        assert {r.id: r.r for r in got} == {i: sum(b <= i for b in bounds) for i in range(-2, 3 * n + 3)}
