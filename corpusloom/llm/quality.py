"""Quality scores by Bradley-Terry ranking.

A document's strength is a linear function of its features; the chance that one document is preferred to another is
the logistic function of the difference of their strengths. The weights come from preference pairs (a document of
label 1 over one of label 0) by logistic loss on feature differences. The cut is a quantile of the strengths of the
training documents, and a strength becomes a score by a logistic curve that meets the cut at the wanted threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import sliced, texts_of
from corpusloom.llm.langid import remainder
from corpusloom.runtime import materialize, ship

SYMBOLS = [ord(c) for c in "!#$%&*|<>=~^_{}[]@\\/+"]
CLOSERS = [ord(c) for c in ".,;:?"]
N_FEATURES = 14
#: Bins a feature is cut into, at quantiles of the training sample.
BINS = 12


def features(text: str) -> list[float]:
    """What the text looks like, without regard to its language or subject. Empty text: zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    data = np.frombuffer(text.encode(), np.uint8)
    seen = np.bincount(data, minlength=256)
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    lines = text.split("\n")
    distinct = len(set(words))
    size = len(data)
    return [
        float(np.log1p(n)),
        distinct / n,
        float(np.log1p(distinct)) / float(np.log1p(n)),
        sum(map(eq, words, words[1:])) / n,
        upper / max(upper + lower, 1),
        int(seen[48:58].sum()) / size,
        int(seen[SYMBOLS].sum()) / size,
        int(seen[CLOSERS].sum()) / n,
        int(seen[128:].sum()) / size,
        (size - len(lines)) / n,
        len(set(lines)) / len(lines),
        len(lines) / n,
        int(seen.max()) / size,
        sum(map(eq, words, words[2:])) / n,
    ]


@dataclass
class PairwiseRanker:
    edges: np.ndarray  # of the bins, by feature
    weights: np.ndarray
    cut: float = 0.0
    scale: float = 1.0
    threshold: float = 0.3

    def expand(self, rows: np.ndarray) -> np.ndarray:
        """Cumulative bin indicators: one for each edge that a feature reaches."""
        rows = rows.reshape(-1, N_FEATURES)
        return (rows[:, :, None] >= self.edges[None]).reshape(len(rows), -1).astype(np.float64)

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return self.expand(rows) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Increasing in the strength, at the threshold where the strength is at the cut."""
        at = np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(self.scale * (self.strength(rows) - self.cut) + at, -60, 60)))

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, *, pairs: int = 20_000, ridge: float = 1.0, threshold: float = 0.3, seed: int = 0) -> PairwiseRanker:
        """rows: features; labels: 1 is preferred to 0. With one class only, all scores are near 1 or near 0."""
        edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(rows) else np.zeros((N_FEATURES, BINS - 1))
        out = cls(edges, np.zeros(N_FEATURES * (BINS - 1)), threshold=threshold)
        good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
        if not len(good) or not len(bad):
            out.cut, out.scale = (1.0 if len(bad) else -1.0), 5.0
            return out
        x = out.expand(rows)
        rng = np.random.default_rng(seed)
        d = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
        w = out.weights
        for _ in range(25):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), d.T @ (1 - p) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        out.weights = w
        s = out.strength(rows)
        # the quantile of the strengths that errs least, the two classes weighing the same in the pairs but not here
        order = np.sort(s)
        levels = np.quantile(order, np.linspace(0, 1, 1001))
        wrong = [((s >= c) != (labels == 1)).sum() for c in levels]
        best = np.flatnonzero(np.array(wrong) == min(wrong))
        out.cut = float(levels[best[len(best) // 2]])
        return out


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 5_000, threshold: float = 0.3) -> PairwiseRanker:
    """Fit on docs (doc_id, text) that labels (doc_id, label 0 or 1) has, per_class documents of each label at most, those of least hash of doc_id.

    The sample's bound is per_class whatever the tables hold: its ids are sent to all tasks, its features to the
    driver. Rows that repeat a doc_id teach once for each text, up to as many in all as there are ids. A document with
    both labels counts as label 1. Null labels and ids teach nothing.
    """
    ship(docs.sparkSession)
    usable = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    least = lambda label: usable.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(per_class)
    picked = materialize(least(0).unionByName(least(1)), "quality-ids")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("row", F.xxhash64("doc_id", "text"))
    chosen = rows.groupBy("doc_id", "label", "row").agg(F.first("text").alias("text")).orderBy("row", "doc_id").limit(2 * per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [features(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    # sorted: the pairs drawn must not depend on the order in which tasks end
    table = chosen.mapInArrow(run, "doc_id long, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    rows = np.array(table["x"].to_pylist(), np.float64).reshape(-1, N_FEATURES)
    return PairwiseRanker.fit(rows, table["label"].to_numpy(), threshold=threshold)


def score(docs: DataFrame, ranker: PairwiseRanker) -> DataFrame:
    """doc_id, score, predicted of each row of docs (doc_id, text; other columns are not looked at).

    Null and empty texts have the features of no words and a score as any other. Null doc_id and repeated rows pass
    through, equal texts have equal scores, very long texts are looked at whole. Empty table: no rows. predicted is 1 where the score reaches the ranker's threshold.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = ranker.scores(np.array([features(t) for t in texts_of(batch)], np.float64))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores), pa.array((scores >= ranker.threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def select_good(docs: DataFrame, ranker: PairwiseRanker) -> DataFrame:
    """The rows of docs (text and any other columns) that score() predicts 1, with all their columns; nulls, empty texts and repeated rows as there."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = ranker.scores(np.array([features(t) for t in texts_of(batch)], np.float64))
            yield batch.filter(pa.array(scores >= ranker.threshold))

    return docs.mapInArrow(run, docs.schema)


def known_labels(spark, sf_dir: str) -> DataFrame:
    """doc_id, label of the documents whose labels may be learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))


def op7(spark, sf_dir: str) -> DataFrame:
    """score over documents, learned from the labels whose crc32(doc_id) mod 5 is not 0; held_out tells the others. A null doc_id counts as empty text. Nulls, empty texts, repeated rows and empty tables as in train and score; lang, source and other columns are not looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, known_labels(spark, sf_dir)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
