"""The recurrent network against finite differences, its windows by their definition, and what it learns on held-out texts."""

import random

import numpy as np
import pytest

from corpusloom.llm import gru, toxicity


def invented(n, seed, toxic_share=0.2):
    """Texts of invented syllables; toxic ones hold words of two stems with endings of their own."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["ta", "re", "mo", "li", "sun", "ka", "ö"], k=rng.randint(1, 4)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(3, 150))]
        toxic = rng.random() < toxic_share
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vexo", "grumb"]) + word())
        out.append((" ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def detector():
    rows = invented(600, 1)
    return toxicity.fit([t for t, _ in rows], np.array([y for _, y in rows]))


def test_gradients_equal_finite_differences():
    network = gru.Network(3)
    for name in network.p:
        network.p[name] = np.random.default_rng(4).standard_normal(network.p[name].shape) * 0.4
    words = gru.Words.of(["one", "two", "ab", "élan", ""])
    windows = np.array([[0, 1, 2, 3], [3, 3, -1, -1], [4, 0, 1, -1]])
    seen = np.array([1.0, 0, 1, 1, 1])
    pull = np.array([0.3, -1.0, 0.7])
    loss = lambda: float(network.logits(network.project(network.inputs(words, seen)), windows) @ pull)
    _, grads = network.gradients(words, windows, seen, lambda _: pull)
    for name, g in grads.items():
        full = np.zeros(network.p[name].shape)
        if isinstance(g, tuple):
            full[g[0]] = g[1]
        else:
            full = g
        flat = network.p[name].reshape(-1)
        nonzero = np.flatnonzero(full.reshape(-1))
        for at in np.random.default_rng(5).choice(nonzero, min(12, len(nonzero)), replace=False):
            kept = flat[at]
            flat[at] = kept + 1e-4
            up = loss()
            flat[at] = kept - 1e-4
            down = loss()
            flat[at] = kept
            assert (up - down) / 2e-4 == pytest.approx(full.reshape(-1)[at], rel=2e-2, abs=2e-3), name


def test_padding_changes_nothing():
    network = gru.Network(1)
    network.p["gram"] *= 10
    projected = network.project(network.inputs(gru.Words.of(["a", "bc", "def"])))
    short = network.logits(projected, np.array([[0, 1, 2]]))
    padded = network.logits(projected, np.array([[0, 1, 2, -1, -1, -1]]))
    assert short == pytest.approx(padded, abs=1e-5)


def test_words_differ_by_their_characters():
    words = gru.Words.of(["abcdef", "abc", "é"])
    assert words.sizes.tolist() == [6 + 5 + 4, 3 + 2 + 1, 1]
    again = words.pick(np.array([2, 0]))
    alone = gru.Words.of(["é", "abcdef"])
    assert again.sizes.tolist() == alone.sizes.tolist()
    assert again.grams.tolist() == alone.grams.tolist()


def test_windows_cover_every_word_and_overlap():
    sizes = np.array([0, 1, 32, 33, 48, 49, 200])
    windows, owner = toxicity.cut(sizes)
    starts = np.cumsum(sizes) - sizes
    for text, n in enumerate(sizes.tolist()):
        mine = windows[owner == text]
        expected = [[starts[text] + i for i in range(at, min(at + 32, n))] for at in range(0, max(n - 16, 1), 16)] if n else []
        assert [[x for x in w if x >= 0] for w in mine.tolist()] == expected
    assert sorted({x for x in windows.ravel().tolist() if x >= 0}) == list(range(sizes.sum()))


def test_held_out_texts_are_told_apart(detector):
    rows = invented(600, 2)
    found = detector.scores([t for t, _ in rows]) >= 0.5
    labels = np.array([y for _, y in rows]) == 1
    assert (found & labels).sum() >= 0.95 * labels.sum()
    assert (found & ~labels).sum() <= 0.03 * (~labels).sum()


def test_a_text_is_as_toxic_as_its_worst_window(detector):
    clean, bad = invented(1, 7, 0.0)[0][0], "li grumbta vexoka grumbli re"
    long = " ".join([clean] * 60)
    assert detector.scores([long])[0] < 0.5 <= detector.scores([f"{long} {bad} {long}"])[0]
    assert (detector.scores([f"{long} {bad} {long}", bad]) >= 0.5).all()


def test_odd_rows_and_other_columns(spark, detector):
    rows = [(1, None), (2, ""), (3, "123 !?"), (None, "ta re"), (4, "ta re"), (4, "ta re"), (5, "grumb vexo " * 30_000)]
    docs = spark.createDataFrame([(i, t, 9.0, "q") for i, t in rows], "doc_id long, text string, score double, predicted string")
    found = sorted((tuple(r) for r in toxicity.score(docs, detector).collect()), key=lambda r: str(r[0]))
    by_id = {r[0]: r for r in found}
    assert len(found) == 7
    assert [by_id[i][1:] for i in (1, 2, 3)] == [(0.0, 0)] * 3
    assert by_id[None][1] == by_id[4][1]
    assert by_id[5][2] == 1
    assert toxicity.score(docs.limit(0), detector).collect() == []


def test_training_is_bounded_and_survives_odd_labels(spark):
    texts = invented(60, 3, 0.5)
    docs = spark.createDataFrame([(i % 50 if i < 55 else None, t) for i, (t, _) in enumerate(texts)] + [(7, "same text")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (3, None), (8, 5)], "doc_id long, label int")
    assert toxicity.train(docs, labels, per_class=10).known
    one = toxicity.train(docs, labels.where("label = 1"), per_class=10)
    assert not one.known and one.scores(["ta", ""]).tolist() == [1.0, 1.0]
    none = toxicity.train(docs.limit(0), labels)
    assert none.scores(["ta"]).tolist() == [0.0]


def test_the_query_scores_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in toxicity.op13(spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    learned = [(found[i].predicted, y) for i, y in labels.items() if not found[i].held_out]
    assert np.mean([p == y for p, y in learned]) > 0.9
    held = [(found[i].score, y) for i, y in labels.items() if found[i].held_out]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85  # few labels at this size: the order, not the cut
