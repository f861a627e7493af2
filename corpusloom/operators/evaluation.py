"""Loss aggregation, with a bigram scorer in place of a neural one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialize, parts_for

#: Bytes of documents on disk whose pairs a task counts before they are shuffled: 3 million words or so, whose distinct pairs stay in memory.
COUNTED_BYTES = 8 << 20


def dealt(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """docs of a table on disk in parts by its size, not by its files or their splits: a part's pairs, unlike its text, grow beyond what a task can hold, and would be sorted on disk."""
    return docs.repartition(parts_for(docs, COUNTED_BYTES), order)


def token_pairs(docs: DataFrame, tokens: Column, order: str = "doc_id", *also: str) -> DataFrame:
    """order, also, x, y, n (1): each place in a document where y follows x. Who counts them groups them as needed, in one shuffle."""
    t = docs.select(order, *also, tokens.alias("t"))
    n = F.greatest(F.size("t") - 1, F.lit(0))
    follow = F.arrays_zip(F.slice("t", F.lit(1), n).alias("x"), F.slice("t", F.lit(2), n).alias("y"))
    return t.select(order, *also, F.explode(follow).alias("p")).select(order, *also, "p.x", "p.y", F.lit(1).cast("long").alias("n"))


def pair_counts(pairs: DataFrame, *by: Column | str) -> DataFrame:
    """by, x, y, n: how often y follows x in each document, batch or whatever the pairs are counted by; without by, in all."""
    return pairs.groupBy(*by, "x", "y").agg(F.sum("n").alias("n"))


#: times of the rows of token_counts that count a token.
TOKEN = -1


def token_counts(counts: DataFrame) -> DataFrame:
    """token, times, c, n, known, of counts by pair (x, y, c when learned, n when asked for).

    times is TOKEN: how often the token is a context in either, and whether what was learned has it; else the token is
    null, and n counts what is asked for of all pairs that were learned so many times. One aggregate over both places
    of a pair: the same rows hold the contexts and the vocabulary.
    """
    types = {f.name: f.dataType for f in counts.schema}
    zero, nothing, token = {k: F.lit(0).cast(types[k]) for k in "cn"}, F.lit(None).cast(types["x"]), F.lit(TOKEN).cast("long")
    c, n, learned = F.col("c"), F.col("n"), F.col("c") > 0
    context, follower, pair = (F.col("x"), token, c, n, learned), (F.col("y"), F.when(learned, token), zero["c"], zero["n"], learned), (nothing, F.when(n > 0, c), zero["c"], n, F.lit(False))
    rows = F.stack(F.lit(3), *context, *follower, *pair).alias("token", "times", "c", "n", "known")
    sums = [F.sum("c").alias("c"), F.sum("n").alias("n"), F.max("known").alias("known")]
    return counts.select(rows).where(F.col("times").isNotNull()).groupBy("token", "times").agg(*sums)


def vocabulary_size(tokens: DataFrame) -> DataFrame:
    """One row, v: the known tokens."""
    return tokens.agg(F.count(F.when(F.col("known"), 1)).alias("v"))


def held_out_loss(pairs: DataFrame, learn: Column, ask: Column, weight: str = "n") -> DataFrame:
    """n, ce: the pairs that ask holds for, by weight, and their cross-entropy by BigramScorer's estimates from those that learn holds for, in a few rows to be summed.

    The sum of -n * ln((c + 1) / (cx + v)) is that of n * ln(cx + v) over contexts less that of n * ln(c + 1) over
    pairs. Each is summed over equal counts first (whole numbers, if the weights are): one shuffle counts the pairs, no
    pair is joined, and there are too few logarithms to add for their rounding to show.
    """
    number = lambda which, n: F.sum(F.when(which, F.col(n)).otherwise(0))
    counts = pairs.where(learn | ask).groupBy("x", "y").agg(number(learn, "n").alias("c"), number(ask, weight).alias("n"))
    # written: read for the vocabulary and for the sums
    tokens = materialize(token_counts(counts), "bigram-tokens")
    sums = tokens.where(F.col("n") > 0).groupBy("times", "c").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(vocabulary_size(tokens)))
    context, n = F.col("times") == TOKEN, F.col("n")
    ce = F.when(context, n * F.log(F.col("c") + F.col("v"))).otherwise(-n * F.log(F.col("times") + 1))
    return sums.select(F.when(context, n).otherwise(0).alias("n"), ce.alias("ce"))


class BigramScorer:
    """Add-one estimates of the next token: -ln((c(x, y) + 1) / (c(x) + vocabulary)). held_out_loss has their sum at less cost."""

    def __init__(self, pairs: DataFrame):
        # written: pairs, contexts and vocabulary are all read from these counts
        self.pairs = materialize(pairs.groupBy("x", "y").agg(F.sum("n").alias("c")), "bigrams")
        tokens = token_counts(self.pairs.withColumn("n", F.lit(0).cast("long")))
        self.contexts = tokens.where(F.col("c") > 0).select(F.col("token").alias("x"), F.col("c").alias("cx"))
        self.size = vocabulary_size(tokens)

    def cross_entropy(self, pairs: DataFrame) -> DataFrame:
        """pairs with ce, the summed cross-entropy of their n occurrences."""
        joined = pairs.join(self.pairs, ["x", "y"], "left").join(self.contexts, "x", "left").crossJoin(F.broadcast(self.size))
        p = (F.coalesce("c", F.lit(0)) + 1) / (F.coalesce("cx", F.lit(0)) + F.col("v"))
        return joined.withColumn("ce", -F.log(p) * F.col("n"))

    def logits(self, context: DataFrame, vocabulary: DataFrame) -> DataFrame:
        """row_id, token_id, logit of each row's next token over a vocabulary (token_id), the scorer of sampling.generate."""
        last = context.groupBy("row_id").agg(F.max_by("token_id", "pos").alias("x"))
        grid = last.crossJoin(F.broadcast(vocabulary.select(F.col("token_id").alias("y"))))
        counted = grid.join(self.pairs, ["x", "y"], "left")
        return counted.select("row_id", F.col("y").alias("token_id"), F.log(F.coalesce("c", F.lit(0)) + 1).alias("logit"))


def token_weighted(scored: DataFrame, order: str = "doc_id", n_docs: DataFrame | None = None) -> DataFrame:
    """nll, perplexity, n_tokens, n_docs: all cross-entropy over all targets, never a mean of means.

    scored may be of pairs that were summed over documents before they were scored, which spares the joins a row for
    each document and pair; n_docs is then a row that counts the documents, as targets() does.
    """
    figures = [(F.sum("ce") / F.sum("n")).alias("nll"), F.sum("n").cast("long").alias("n_tokens")]
    out = scored.agg(*figures, F.countDistinct(order).alias("n_docs")) if n_docs is None else scored.agg(*figures).crossJoin(F.broadcast(n_docs))
    return out.select(F.round("nll", 9).alias("nll"), F.round(F.exp("nll"), 6).alias("perplexity"), "n_tokens", "n_docs")


def targets(docs: DataFrame, tokens: Column, order: str = "doc_id") -> DataFrame:
    """One row, n_docs: the documents that have a token after another."""
    return docs.where(F.size(tokens) >= 2).agg(F.countDistinct(order).alias("n_docs"))


def batch_mean(scored: DataFrame, batch: Column) -> DataFrame:
    """Mean of the batches' mean losses, as validation during training takes it."""
    means = scored.groupBy(batch.alias("batch")).agg((F.sum("ce") / F.sum("n")).alias("loss"))
    return means.agg(F.round(F.avg("loss"), 9).alias("val_loss"), F.count("*").alias("n_batches"))


def batch_shares(docs: DataFrame, tokens: Column, batch: str) -> DataFrame:
    """batch, share: one over the targets of each batch of documents that has any, what a target weighs in the mean of the batches' means."""
    n = docs.groupBy(batch).agg(F.sum(F.greatest(F.size(tokens) - 1, F.lit(0))).alias("n")).where(F.col("n") > 0)
    # written: a small table, whose size the planner then knows
    return materialize(n.select(batch, (1 / F.col("n")).alias("share")), "shares")


def mean_of_batches(scored: DataFrame, shares: DataFrame) -> DataFrame:
    """As batch_mean, of pairs that were summed over all batches by their shares (batch_shares)."""
    n = shares.agg(F.count("*").alias("n_batches"))
    total = scored.agg(F.sum("ce").alias("ce")).crossJoin(F.broadcast(n))
    return total.select(F.round(F.when(F.col("n_batches") > 0, F.col("ce") / F.col("n_batches")), 9).alias("val_loss"), "n_batches")


def compression(docs: DataFrame, n_tokens: Column, gate: float) -> DataFrame:
    """n_chars, n_tokens, n_docs, ratio of characters to tokens (0.0 without tokens), its gain over one character a token, and whether it reaches the gate."""
    sums = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.sum(n_tokens), F.lit(0)).cast("long").alias("n_tokens"), F.count("*").alias("n_docs"))
    ratio = F.when(F.col("n_tokens") > 0, F.col("n_chars") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return sums.withColumn("ratio", F.round(ratio, 9)).withColumn("gain", F.round(ratio - 1.0, 9)).withColumn("passes", ratio >= gate)
