"""Operators that learn: held-out accuracy, recall against brute force, defined edge cases."""

import zlib

import numpy as np

from corpusloom.llm import langid, mih, quality, queries

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = queries.QUERIES["op3_language_id"](spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(lang, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert len(found) == len(lang) and (held.lang_pred == held.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_edges(spark):
    texts = {"en": "the cat and the dog sat on the mat", "de": "der hund und die katze sind auf der matte"}
    rows = [(i, texts[lang], lang) for i in range(40) for lang in ("en", "de")] + [(None, "x", None), (1, None, "en")]
    models = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "123 !", "q"), (None, "der hund", "q"), (5, "THE CAT " * 5000, "q"), (5, "漢字", "q"), (7, "²½ Ⅷ ① 12", "q")], "doc_id long, text string, lang_pred string")
    got = langid.identify(docs, models).collect()
    assert [r.lang_pred for r in got][:5] == ["und", "und", "und", "de", "en"] and len(got) == 7
    assert [r.score for r in got][:3] == [0, 0, 0] and not got[5].accepted
    assert got[6].lang_pred == "und" and got[6].score == 0
    assert langid.identify(docs.limit(0), models).collect() == []
    nothing = langid.train(docs.limit(0).withColumnRenamed("lang_pred", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def brute_kneser_ney(counts, order, alphabet):
    """lang -> function of (context, character): the interpolated Kneser-Ney probability, from its definition."""
    from collections import Counter, defaultdict

    def model(words):
        levels = [Counter() for _ in range(order + 1)]
        for word, n in words.items():
            marked = "\x02" * (order - 1) + word + "\x03"
            for i in range(order - 1, len(marked)):
                levels[order][marked[i - order + 1 : i + 1]] += n
        for k in range(order - 1, 0, -1):
            for gram in levels[k + 1]:
                levels[k][gram[1:]] += 1
        tables = []
        for k in range(1, order + 1):
            ones, twos = (sum(c == x for c in levels[k].values()) for x in (1, 2))
            discount = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.95)
            mass, kinds = defaultdict(int), defaultdict(int)
            for gram, c in levels[k].items():
                mass[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            tables.append((levels[k], discount, mass, kinds))

        def p(context, c):
            out = 1 / (len(alphabet) + 1)
            for k, (table, discount, mass, kinds) in enumerate(tables, 1):
                h = context[len(context) - k + 1 :]
                if mass[h]:
                    out = max(table[h + c] - discount, 0) / mass[h] + min(discount * kinds[h] / mass[h], 1) * out
            return out

        return p

    return {lang: model(words) for lang, words in counts.items()}


def test_kneser_ney_against_its_definition():
    import random
    from collections import Counter

    rng = random.Random(1)
    counts = {lang: Counter({"".join(rng.choices(letters, k=rng.randint(1, 6))): rng.randint(1, 4) for _ in range(60)}) for lang, letters in (("x", "abcd"), ("y", "cdefg"))}
    for order in (2, 4):
        models = langid.LanguageModels.fit(counts, order=order)
        alphabet = {c for words in counts.values() for w in words for c in w} | {"\x02", "\x03"}
        brute = brute_kneser_ney(counts, order, alphabet)
        words = [*list(counts["x"])[:20], *list(counts["y"])[:20], "zzz", "abz", "a"]
        got = models.word_scores(words)
        for row, word in zip(got, words, strict=True):
            marked = "\x02" * (order - 1) + word + "\x03"
            wanted = [-sum(np.log(brute[lang](marked[i - order + 1 : i], marked[i])) for i in range(order - 1, len(marked))) for lang in models.langs]
            assert np.allclose(row[:-1], wanted, rtol=1e-4) and row[-1] == len(word) + 1
        # a context's probabilities leave no more than the share of characters never seen
        for context in ("\x02" * (order - 1), "a" * (order - 1)):
            total = sum(brute["x"](context, c) for c in alphabet)
            assert 0.5 < total <= 1 + 1e-9


def test_quality_held_out(spark):
    found = queries.QUERIES["op7_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").toPandas()
    both = found.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.93
    assert (both[both.quality == 1].predicted == 1).mean() > 0.98 and found.score.between(0, 1).all()


def test_quality_features_by_hand():
    text = "Ab ab ab, 12!\nX é é\nX é é"
    words = text.split()
    data = text.encode()
    f = quality.features(text)
    assert f[0] == np.log1p(len(words)) and f[1] == len(set(words)) / len(words)
    assert f[3] == sum(a == b for a, b in zip(words, words[1:])) / len(words)
    assert f[4] == 3 / 8 and f[5] == 2 / len(data) and f[8] == 8 / len(data) and f[10] == 2 / 3
    assert f[12] == max(data.count(bytes([b])) for b in set(data)) / len(data)
    assert quality.features("") == [0.0] * quality.N_FEATURES == quality.features(" \n")


def test_ranker_minimises_the_pairwise_loss():
    """The weights against the gradient of the loss over the same pairs, and the cut against every other."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, quality.N_FEATURES))
    labels = (rows[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    ranker = quality.PairwiseRanker.fit(rows, labels, pairs=2_000)
    x = ranker.expand(rows)
    assert np.array_equal(x.reshape(300, quality.N_FEATURES, -1), rows[:, :, None] >= ranker.edges[None])
    again = np.random.default_rng(0)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    d = x[again.choice(good, 2_000)] - x[again.choice(bad, 2_000)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).sum() + 0.5 * (w @ w)
    gradient = -(d.T @ (1 / (1 + np.exp(d @ ranker.weights)))) + ranker.weights
    assert np.abs(gradient).max() < 1e-3
    assert all(loss(ranker.weights) <= loss(ranker.weights + 0.01 * rng.normal(size=x.shape[1])) for _ in range(20))
    strength = ranker.strength(rows)
    wrong = lambda c: ((strength >= c) != (labels == 1)).sum()
    assert wrong(ranker.cut) <= min(wrong(c) for c in np.quantile(strength, np.linspace(0, 1, 101)))
    scores = ranker.scores(rows)
    assert ((scores >= 0.3) == (strength >= ranker.cut)).all() and (np.argsort(scores, kind="stable") == np.argsort(strength, kind="stable")).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "Good words here.", 5.0), (4, "BAD!! " * 9000, 5.0), (4, "x", 5.0)], "doc_id long, text string, score double")
    for labels in ([], [(1, 0)], [(1, 1), (4, 0), (4, None), (None, 1)]):
        ranker = quality.train(docs, spark.createDataFrame(labels, "doc_id long, label int"))
        got = quality.score(docs, ranker).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert quality.select_good(docs, ranker).columns == docs.columns
    assert quality.score(docs.limit(0), ranker).collect() == []


def test_multi_index_is_exact():
    rng = np.random.default_rng(0)
    for bits in (24, 100):
        codes = mih.encode(rng.normal(size=(700, bits)), np.eye(bits))
        index = mih.MultiIndex(codes, bits)
        for radius in (0, 1, 3, 7, 9, 24, 40, bits):
            for q in codes[:20]:
                assert set(index.within(q, radius).tolist()) == set(np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius).tolist())


def test_multi_index_prunes_where_neighbours_are_near():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 64))
    x = np.repeat(centres, 20, axis=0) + 0.25 * rng.normal(size=(4000, 64))
    rotation, radius = mih.learn(x)
    index = mih.MultiIndex(mih.encode(x, rotation), 128)
    share = np.mean([len(index.probed(c, radius)) for c in index.codes[:100]]) / len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = [len(set(index.within(index.codes[i], radius)) & set(np.argsort(-(unit @ unit[i]))[1:6])) for i in range(0, 4000, 40)]
    assert share < 0.2 and np.mean(hits) / 5 >= 0.9


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(3001, None), (3002, [0.0] * 32), (3003, [float("nan")] * 32), (3004, [1.0]), (None, x[0].tolist()), (3050, x[9].tolist()), (3051, x[9].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mih.nearest(vectors, vectors.where("vec_id % 50 = 0")).toPandas()
    unit = np.concatenate((x, x[[9, 9]]))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.array([*range(3000), 3050, 3051])
    hits = 0
    asked = [i for i in range(0, 3000, 50)] + [3050]
    for q in asked:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -2
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 5 and mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, [s[ids == v][0] for v in mine.vec_id])
        hits += len(set(mine.vec_id) & set(ids[np.lexsort((ids, -s))[:5]]))
    assert hits / (5 * len(asked)) >= 0.9
    assert set(got[(got.query_id == 3050) & (got["rank"] <= 2)].vec_id) == {9, 3051}
    few = vectors.where("vec_id in (0, 1, 2)")
    assert mih.nearest(few, few.where("vec_id = 0")).count() == 2
    assert mih.nearest(vectors.limit(0), vectors.limit(0)).collect() == []


def test_op5_recall(spark):
    found = queries.QUERIES["op5_multi_index"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(table.embedding.tolist(), np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits, n = table.vec_id.to_numpy(), 0, 0
    for q in ids[ids % 50 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -2
        best = set(ids[np.lexsort((ids, -s))[:5]])
        hits, n = hits + len(best & set(found[found.query_id == q].vec_id)), n + 5
    assert hits / n >= 0.9
