"""Language identification with interpolated Kneser-Ney character models.

A language's model gives each character of a word (lower-cased letters between two boundary marks) its probability
after up to ORDER - 1 characters before it. All languages share, for each order, one sorted array of n-gram hashes and
one of context hashes, with a column for each language. A text goes to the language of lowest cross-entropy per
character; a temperature and a limit for rejection are calibrated on training documents kept out of the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import sliced, texts_of
from corpusloom.llm.hashing import mix64
from corpusloom.runtime import materialize, ship

#: Runs of letters, of Unicode category L: neither digits nor other numbers such as \u00b2 or \u2167.
LETTERS = regex.compile(r"\p{L}+").findall
START, END = 2, 3


def characters(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with order - 1 start marks before and an end mark after each; the word's number at each character to score, -1 at start marks."""
    joined = np.frombuffer("\x03".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = joined == END
    word = np.concatenate(([0], np.cumsum(ends)[:-1])).astype(np.int64) if len(joined) else np.zeros(0, np.int64)
    pads = order - 1
    at = np.arange(len(joined)) + pads * (word + 1)
    chars = np.full(len(joined) + pads * len(words), START, np.uint64)
    owner = np.full(len(chars), -1, np.int64)
    chars[at], owner[at] = joined, word
    return chars, owner


def gram_hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order, the hash of the k characters that end at each position."""
    out = [np.full(len(chars), 1, np.uint64)]
    for _ in range(order):
        before = np.concatenate((out[-1][:1], out[-1][:-1]))
        out.append(mix64(before) + chars * np.uint64(0x9E3779B97F4A7C15))
    return out


@dataclass
class LanguageModels:
    langs: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]  # for each order: sorted hashes, discounted probability by language
    contexts: list[tuple[np.ndarray, np.ndarray]]  # for each order: sorted context hashes, interpolation weight by language
    base: float
    temperature: float = 1.0
    limits: np.ndarray | None = None  # cross-entropy above which a text is rejected, by language

    @classmethod
    def fit(cls, counts: dict[str, Counter], order: int = 4) -> LanguageModels:
        """counts: for each language its words and how often each occurs."""
        langs = sorted(counts)
        tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        alphabet: set[int] = set()
        for lang in langs:
            words = list(counts[lang])
            times = np.fromiter(counts[lang].values(), np.float64, len(words))
            chars, owner = characters(words, order)
            alphabet |= set(np.unique(chars).tolist())
            scored, hashes = np.flatnonzero(owner >= 0), gram_hashes(chars, order)
            grams, first = hashes[order][scored], None
            weight = times[owner[scored]]
            own = []
            for k in range(order, 0, -1):
                distinct, first, group = np.unique(grams, return_index=True, return_inverse=True)
                total = np.bincount(group, weight)
                own.append((distinct, hashes[k - 1][scored[first] - 1] if k > 1 else np.full(len(distinct), 1, np.uint64), total))
                # a lower order counts in how many kinds of higher n-gram its n-gram occurs
                scored, weight = scored[first], np.ones(len(first))
                grams = hashes[k - 1][scored]
            tables.append(own[::-1])
        gram_tables, context_tables = [], []
        for k in range(order):
            all_grams = np.unique(np.concatenate([t[k][0] for t in tables]))
            all_contexts = np.unique(np.concatenate([t[k][1] for t in tables]))
            p, w = np.zeros((len(all_grams), len(langs)), np.float32), np.ones((len(all_contexts), len(langs)), np.float32)
            for i, own in enumerate(tables):
                hashes, contexts, total = own[k]
                ones, twos = (total == 1).sum(), (total == 2).sum()
                discount = float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.1, 0.95))
                at = np.searchsorted(all_contexts, contexts)
                mass, kinds = np.bincount(at, total, len(all_contexts)), np.bincount(at, minlength=len(all_contexts))
                p[np.searchsorted(all_grams, hashes), i] = np.maximum(total - discount, 0) / mass[at]
                seen = mass > 0
                w[seen, i] = np.minimum(total.max() and discount * kinds[seen] / mass[seen], 1.0)
            gram_tables.append((all_grams, p))
            context_tables.append((all_contexts, w))
        return cls(langs, order, gram_tables, context_tables, 1.0 / (len(alphabet) + 1))

    @staticmethod
    def _rows(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, missing: float) -> np.ndarray:
        keys, values = table
        distinct, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        found = keys[at] == distinct
        return np.where(found[:, None], values[at], np.float32(missing))[back]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """For each word its negative log probability under each language, then its number of characters (with the end mark)."""
        out = np.zeros((len(words), len(self.langs) + 1))
        if not words:
            return out
        chars, owner = characters(words, self.order)
        scored, hashes = np.flatnonzero(owner >= 0), gram_hashes(chars, self.order)
        p = np.full((len(scored), len(self.langs)), self.base, np.float32)
        for k in range(1, self.order + 1):
            context = hashes[k - 1][scored - 1] if k > 1 else np.full(len(scored), 1, np.uint64)
            p = self._rows(self.grams[k - 1], hashes[k][scored], 0.0) + self._rows(self.contexts[k - 1], context, 1.0) * p
        starts = np.flatnonzero(np.diff(owner[scored], prepend=-1))
        out[:, :-1] = np.add.reduceat(-np.log(np.maximum(p, 1e-30)), starts, axis=0)
        out[:, -1] = np.diff(np.append(starts, len(scored)))
        return out

    def decide(self, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From summed word_scores: best language, its posterior, its cross-entropy, whether it is accepted."""
        with np.errstate(divide="ignore", invalid="ignore"):
            entropy = totals[:, :-1] / np.maximum(totals[:, -1:], 1)
        best = entropy.argmin(1)
        lowest = entropy[np.arange(len(best)), best]
        sharp = self.temperature * np.sqrt(totals[:, -1:])
        score = 1 / np.exp(-(entropy - lowest[:, None]) * sharp).sum(1) if len(best) else lowest
        accepted = lowest <= (self.limits[best] if self.limits is not None else np.inf)
        return best, score, lowest, accepted

    def calibrate(self, totals: np.ndarray, langs: list[str], keep: float = 0.999) -> None:
        """From summed word_scores of texts and their languages: temperature of least log loss; per language the cross-entropy that a share `keep` of its texts stays under."""
        totals = totals.reshape(-1, len(self.langs) + 1)
        used = totals[:, -1] > 0
        truth = np.array([self.langs.index(x) if x in self.langs else -1 for x in langs])
        used &= truth >= 0
        totals, truth = totals[used], truth[used]
        self.limits = np.full(len(self.langs), np.inf)
        if not len(truth):
            return
        entropy = totals[:, :-1] / totals[:, -1:]
        losses = []
        grid = np.geomspace(0.05, 50, 40)
        for t in grid:
            z = -(entropy - entropy.min(1, keepdims=True)) * t * np.sqrt(totals[:, -1:])
            losses.append(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1))).mean())
        self.temperature = float(grid[int(np.argmin(losses))])
        for i in range(len(self.langs)):
            own = entropy[truth == i, i]
            if len(own):
                self.limits[i] = np.quantile(own, keep) * 1.1


class Scorer:
    """Sums word scores over texts; scores of white-space separated words are remembered, up to `most`."""

    def __init__(self, models: LanguageModels, most: int = 400_000):
        self.models, self.most = models, most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.models.langs) + 1))

    def _learn(self, new: list[str]) -> None:
        if len(self.number) + len(new) > self.most:
            self._clear()
        letters = [LETTERS(w) for w in new]
        flat = self.models.word_scores([x for found in letters for x in found])
        sizes = np.array([len(x) for x in letters])
        rows = np.zeros((len(new), flat.shape[1]))
        if len(flat):
            np.add.at(rows, np.repeat(np.arange(len(new)), sizes), flat)
        at = len(self.number)
        if at + len(new) > len(self.scores):
            grown = np.zeros((max(2 * len(self.scores), at + len(new)), flat.shape[1]))
            grown[:at] = self.scores[:at]
            self.scores = grown
        self.scores[at : at + len(new)] = rows
        self.number.update(zip(new, range(at, at + len(new)), strict=True))

    def totals(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        for first in range(0, len(texts), 256):
            split = [t.lower().split() for t in texts[first : first + 256]]
            words = set().union(*split)
            new = [w for w in words if w not in self.number]
            if len(self.number) + len(new) > self.most:
                self._clear()
                new = list(words)
            self._learn(new)
            number = self.number.__getitem__
            for i, found in enumerate(split):
                if found:
                    at = np.fromiter(map(number, found), np.int64, len(found))
                    out[first + i] = self.scores[at].sum(0)
        return out


def train(labelled: DataFrame, *, per_lang: int = 2_000, order: int = 4) -> LanguageModels:
    """Fit on labelled (doc_id, text, lang), about per_lang documents of each language, taken by a hash of doc_id and text.

    At most one and a half times per_lang documents a language are taken in all, whatever the table holds: rows that
    repeat a doc_id and text count once, and the hash bounds the others. A fifth of them is kept out of the counts,
    for calibration. Rows with null text or lang teach nothing.
    """
    ship(labelled.sparkSession)
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModels([], order, [], [], 1.0)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_lang / n))])
    drawn = usable.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("key", F.abs(F.col("row") % 1_000_000)).where(F.col("key") < share[F.col("lang")] * 1_000_000)
    drawn = drawn.groupBy("lang", "row").agg(F.first("text").alias("text"), F.first("key").alias("key"))
    chosen = materialize(drawn.orderBy("row", "lang").limit(3 * per_lang * len(sizes) // 2), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in sliced(batches):
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(LETTERS(text.lower()))
        rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
        langs, words, times = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"])

    fifth = F.pmod(F.xxhash64("row", F.lit("calibration")), F.lit(5)) == 0
    counted = chosen.where(~fifth).select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, Counter] = {}
    table = counted.toArrow()
    for lang, word, n in zip(table["lang"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist(), strict=True):
        words.setdefault(lang, Counter())[word] = n
    words = {lang: c for lang, c in words.items() if c} or {lang: Counter(["a"]) for lang in sizes}
    models = LanguageModels.fit(words, order)
    # scored where they are: what comes to the driver is a number a language for each, and the sample's size is bounded
    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(scorer.totals(texts_of(batch)).tolist(), pa.list_(pa.float64()))], ["lang", "totals"])

    kept = chosen.where(fifth & (F.col("key") < 200_000 * share[F.col("lang")])).select("text", "lang")
    measured = kept.mapInArrow(measure, "lang string, totals array<double>").toArrow()
    models.calibrate(np.array(measured["totals"].to_pylist(), np.float64), measured["lang"].to_pylist())
    return models


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted of each row of docs (doc_id, text; other columns are not looked at).

    lang_pred is a learned language, or `und` with score 0 where the text is null or has no letters, or where nothing
    was learned. Very long texts are scored whole. Empty table: no rows. accepted is false where the cross-entropy is above the language's calibrated limit: text of no learned
    language. Ties go to the first language by name. Null doc_id and repeated rows pass through.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(models)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        scorer = Scorer(models) if models.langs else None
        for batch in sliced(batches):
            texts = texts_of(batch)
            totals = scorer.totals(texts) if scorer else np.zeros((len(texts), 2))
            found = totals[:, -1] > 0
            best, score, lowest, accepted = models.decide(totals)
            langs = [models.langs[b] if ok else "und" for b, ok in zip(best.tolist(), found.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(np.where(found, score, 0.0)), pa.array(np.where(found, lowest, 0.0)), pa.array(found & accepted)], ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def op3(spark, sf_dir: str) -> DataFrame:
    """identify over documents, learned from those whose crc32(doc_id) mod 4 is not 2; held_out tells the others. A null doc_id counts as empty text. Nulls, texts without letters, ties, repeated rows and empty tables as in train and identify; source and other columns are not looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = identify(docs, models)
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
