"""Token packing, training and evaluation windows, resumable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import with_prefix
from corpusloom.runtime import materialize


def packed_offsets(docs: DataFrame, n_tokens: Column, by: list[str], order: str = "doc_id") -> DataFrame:
    """docs with n_tokens and token_offset, the tokens of their group before them."""
    return with_prefix(docs.withColumn("n_tokens", n_tokens.cast("long")), [order], {"token_offset": F.col("n_tokens")}, by)


def check_range(ids: Column, largest: int) -> Column:
    """ids, or an error if one is outside 0..largest: checked before any narrowing cast."""
    bad = F.exists(ids, lambda x: (x < 0) | (x > largest))
    return F.when(bad, F.raise_error(F.lit(f"a token id is outside 0..{largest}"))).otherwise(ids)


def train_windows(docs: DataFrame, ids: Column, block: int, order: str = "doc_id") -> DataFrame:
    """window_id, x, y of the packed stream: block tokens and the same shifted by one; the part window at the end is dropped.

    A document's tokens are cut at window bounds first, so what is shuffled is slices of arrays and not single
    tokens; each window then joins its few slices. Windows cross documents. The ids are written once: they are read for
    their number, their places and their slices.
    """
    held = materialize(docs.select(order, ids.alias("ids")).withColumn("n", F.size("ids").cast("long")), "token-ids").where("n > 0")
    placed = with_prefix(held, [order], {"at": F.col("n")})
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # window w reads tokens w*block .. (w+1)*block, the last of which is the first of the next window too
    first = F.greatest(F.lit(0), F.floor((F.col("at") - 1) / block)).cast("long")
    last = F.floor((F.col("at") + F.col("n") - 1) / block).cast("long")

    def slice_of(window: Column) -> Column:
        low = F.greatest(F.lit(0).cast("long"), window * block - F.col("at"))
        high = F.least(F.col("n"), (window + 1) * block + 1 - F.col("at"))
        return F.struct(window.alias("window_id"), (F.col("at") + low).alias("p"), F.slice("ids", (low + 1).cast("int"), F.greatest(F.lit(0), high - low).cast("int")).alias("part"))

    # cut inside the row: exploding windows beside whole documents would copy each document once a window
    cut = placed.select(F.explode(F.transform(F.sequence(first, last), slice_of)).alias("s")).select("s.*").where(F.size("part") > 0)
    joined = cut.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("p", "part"))).alias("parts"))
    whole = joined.select("window_id", F.flatten("parts.part").alias("t")).crossJoin(total).where(F.col("window_id") < F.floor((F.col("total") - 1) / block))
    return whole.select("window_id", F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))


def eval_windows(docs: DataFrame, ids: Column, block: int, order: str = "doc_id") -> DataFrame:
    """order, start, x, y: each document's own windows, the short one at the end kept; fewer than two tokens give none."""
    # no filter on the ids' number: it would make them twice
    held = docs.select(order, ids.alias("ids"))
    starts = F.when(F.size("ids") >= 2, F.sequence(F.lit(0), F.greatest(F.size("ids") - 2, F.lit(0)), F.lit(block))).otherwise(F.array().cast("array<int>"))

    def window(start: Column) -> Column:
        size = F.least(F.lit(block), F.size("ids") - 1 - start)
        return F.struct(start.cast("long").alias("start"), F.slice("ids", start + 1, size).alias("x"), F.slice("ids", start + 2, size).alias("y"))

    cut = held.select(order, F.explode(F.transform(starts, window)).alias("w"))
    return cut.select(order, "w.*")


def limited(windows: DataFrame, max_windows: int | None, max_docs: int | None, order: str = "doc_id") -> DataFrame:
    """The first windows, of the first documents; a report over a stated number of either."""
    if max_docs is not None:
        windows = windows.join(windows.select(order).distinct().orderBy(order).limit(max_docs), order, "left_semi")
    return windows if max_windows is None else windows.orderBy(order, "start").limit(max_windows)


def permutation(n: int, epoch: int, spark, seed: int = 0) -> DataFrame:
    """epoch, pos, window_id: a deterministic order of n windows, by a keyed hash.

    Hash ranges of equal width are sorted each on its own and placed by their sizes (with_prefix).
    """
    keyed = spark.range(n).select(F.col("id").alias("window_id"), F.xxhash64(F.lit(seed + epoch), "id").alias("h"))
    return with_prefix(keyed, ["h", "window_id"], {"pos": F.lit(1)}).select(F.lit(epoch).alias("epoch"), "pos", "window_id")


def numpy_permutation(n: int, epoch: int, seed: int = 0) -> list[int]:
    """The order that numpy's generator gives, for parity with numpy-based loaders; on the driver, n bounded by the caller."""
    import numpy as np

    return np.random.default_rng(seed + epoch).permutation(n).tolist()


def positions(steps: DataFrame, n_windows: int, per_step: int, base_seed: int = 0) -> DataFrame:
    """step, pos, epoch, index, seed: which windows the steps (step) consume, for a loader that can seek."""
    pos = steps.select("step", F.explode(F.sequence(F.col("step") * per_step, (F.col("step") + 1) * per_step - 1)).alias("pos"))
    epoch = F.floor(F.col("pos") / n_windows).cast("long")
    return pos.select("step", "pos", epoch.alias("epoch"), (F.col("pos") % n_windows).alias("index"), (epoch + base_seed).alias("seed"))


