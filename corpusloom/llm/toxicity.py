"""Toxicity of texts, by a recurrent network over all their overlapping windows.

A text is cut into windows of WINDOW words, each starting STEP words after the one before; a bidirectional gated
recurrent network (gru.py) gives every window a logit, and the text has that of its most toxic window. Labels are of
whole texts, so training is by multiple instances: after a start in which all windows bear their text's label, each
text teaches through the window that the network finds the most toxic at the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import sliced, texts_of
from corpusloom.llm.gru import Network, Trainer, Words
from corpusloom.llm.langid import remainder
from corpusloom.runtime import ship

#: Runs of letters.
LETTERS = regex.compile(r"[^\W\d_]+").findall
#: Words in a window, and from one window's start to the next one's.
WINDOW, STEP = 32, 16
#: Windows that are read at once.
TOGETHER = 2_048


def cut(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts of these numbers of words, one after another: each a row of places in all words, -1 beyond its text's end; and the text of each. A text without words has none; each word is in one window at least."""
    windows = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STEP), 0)
    owner = np.repeat(np.arange(len(sizes)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[owner] + nth * STEP
    places = starts[:, None] + np.arange(WINDOW)
    return np.where(places < ends[owner][:, None], places, -1), owner


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of the texts, lower-cased; the windows as rows of numbers of such words; the text of each window."""
    split = [LETTERS(t.lower()) for t in texts]
    encoded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
    places, owner = cut(np.array([len(words) for words in split], np.int64))
    numbers = np.append(encoded.indices.to_numpy().astype(np.int64), -1)
    return encoded.dictionary.to_pylist(), numbers[places], owner


@dataclass
class Detector:
    network: Network
    cut: float = 0.0
    known: bool = True  # whether both labels were seen

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window of the texts, and the text of each."""
        words, windows, owner = numbered(texts)
        if not len(windows):
            return np.zeros(0, np.float32), owner
        projected = self.network.project(self.network.inputs(Words.of(words)))
        parts = [self.network.logits(projected, windows[i : i + TOGETHER]) for i in range(0, len(windows), TOGETHER)]
        return np.concatenate(parts), owner

    def strengths(self, texts: list[str]) -> np.ndarray:
        """The highest logit among each text's windows; -inf for a text without words."""
        logits, owner = self.windows(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, logits)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1, at 0.5 where the strength meets the cut; 0 for a text without words."""
        if not self.known:
            return np.full(len(texts), 1.0 if self.cut < 0 else 0.0)
        return 1 / (1 + np.exp(-np.clip(self.strengths(texts) - self.cut, -30, 30))) * np.array([bool(LETTERS(t)) for t in texts])


def fit(texts: list[str], labels: np.ndarray, *, share: float | None = None, start_steps: int = 100, rounds: int = 12, batch: int = 256, seed: int = 0) -> Detector:
    """Train on texts with labels 0 and 1; a fifth of them is kept out for the cut. With one label only, all scores are that label.

    share: of label 1 among all labelled texts, where the given ones are a sample that has another; errors weigh as
    they would among all, so that texts which either label fits go to the commoner one. start_steps: updates
    of the first stage at the least; rounds: how often the second goes through the texts.
    """
    network = Network(seed)
    if len(set(labels.tolist())) < 2:
        return Detector(network, -1.0 if (labels == 1).any() else 1.0, known=False)
    given = float((labels == 1).mean())
    share = min(max(given if share is None else share, 0.01), 0.99)
    weigh = np.where(labels == 1, share / given, (1 - share) / (1 - given)).astype(np.float32)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 5 == 4
    if len(set(labels[aside].tolist())) < 2 or len(set(labels[~aside].tolist())) < 2:
        aside[:] = False
    words, windows, owner = numbered([t if not out else "" for t, out in zip(texts, aside.tolist(), strict=True)])
    features, trainer = Words.of(words), Trainer(network)
    positives = labels[owner] == 1

    def teach(rows: np.ndarray) -> None:
        for at in np.array_split(rng.permutation(len(rows)), -(-len(rows) // batch)):
            mine = windows[rows[at]]
            used, place = np.unique(mine, return_inverse=True)
            place = place.reshape(mine.shape)
            if used[0] < 0:
                used, place = used[1:], place - 1
            truth, w = positives[rows[at]], weigh[owner[rows[at]]] / len(at)
            seen = (rng.random(len(used)) < 0.5).astype(np.float32)  # half the words are known by their characters alone
            trainer.update(network.gradients(features.pick(used).thinned(rng, 0.3), place, seen, lambda s, truth=truth, w=w: w * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - truth))[1])

    for _ in range(-(-start_steps * batch // len(windows))):
        teach(np.arange(len(windows)))
    for _ in range(rounds):
        projected = network.project(network.inputs(features))
        logits = np.concatenate([network.logits(projected, windows[i : i + TOGETHER]) for i in range(0, len(windows), TOGETHER)])
        by_text = np.lexsort((-logits, owner))
        first = np.flatnonzero(np.diff(owner[by_text], prepend=-1))
        teach(by_text[first])
    detector = Detector(network)
    held = np.flatnonzero(aside) if aside.any() else np.arange(len(texts))
    strengths = detector.strengths([texts[i] for i in held])
    able = np.isfinite(strengths)
    detector.cut = between(strengths[able], labels[held][able], weigh[held][able])
    return detector


def between(strengths: np.ndarray, labels: np.ndarray, weigh: np.ndarray) -> float:
    """The middle of the widest stretch of strengths where a cut errs least by weight."""
    if not len(strengths):
        return 0.0
    order = np.argsort(strengths, kind="stable")
    s, positive, w = strengths[order], labels[order] == 1, weigh[order].astype(np.float64)
    missed = np.concatenate([[0], np.cumsum(w * positive)])
    raised = (w * ~positive).sum() - np.concatenate([[0], np.cumsum(w * ~positive)])
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    wrong = np.where(np.diff(edges) > 0, missed + raised, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    widest = best[np.argmax(np.diff(edges)[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1_000, longest: int = 8_192) -> Detector:
    """Fit on docs (doc_id, text) that labels (doc_id, label 0 or 1) has: at most per_class texts of label 1 and twice as many of label 0, of at most `longest` bytes, those of least hash.

    The bounds hold whatever the tables hold: labels are taken by ordered hash, four times as many ids as texts are
    wanted, and of the rows that have these ids (a repeated id has many) again the first by hash. A document
    with both labels counts as label 1. Null labels, ids and texts teach nothing.
    """
    ship(docs.sparkSession)
    usable = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    texts: list[str] = []
    marks: list[int] = []
    short = docs.select("doc_id", "text").where((F.octet_length("text") > 0) & (F.octet_length("text") <= longest))
    for label, most in ((0, 2 * per_class), (1, per_class)):
        picked = usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(4 * most)
        rows = short.join(F.broadcast(picked), "doc_id").select("text", F.xxhash64("doc_id", "text").alias("key"))
        found = rows.distinct().orderBy("key", "text").limit(most).toArrow()
        texts += found["text"].to_pylist()
        marks += [label] * found.num_rows
    order = np.random.default_rng(0).permutation(len(texts))
    return fit([texts[i] for i in order], np.array(marks, np.int64)[order], share=sizes.get(1, 0) / max(sum(sizes.values()), 1))


def score(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, score, predicted of each row of docs (doc_id, text; other columns are not looked at).

    Every window of a text is scored, however long the text is. Null and empty texts and those without letters score
    0. Null doc_id and repeated rows pass through, equal texts have equal scores; an empty table gives no rows.
    predicted is 1 from a score of 0.5 on. One narrow pass; the network, of a fixed size, is broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(detector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = shared.value.scores(texts_of(batch)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def known_labels(spark, sf_dir: str) -> DataFrame:
    """doc_id, label of the documents whose toxicity may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))


def op13(spark, sf_dir: str) -> DataFrame:
    """score over documents, learned from the labels whose crc32(doc_id) mod 5 is not 0; held_out tells the others. A null doc_id counts as empty text. Nulls, empty texts, repeated rows and empty tables as in train and score; lang, source and other columns are not looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, known_labels(spark, sf_dir)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
