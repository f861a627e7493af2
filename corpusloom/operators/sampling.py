"""Sampling rules over a table of logits (row_id, token_id, logit), in the order penalty, temperature, top-k, top-p, softmax, draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def penalize(logits: DataFrame, context: DataFrame, penalty: float, block: int | None = None) -> DataFrame:
    """Logits of tokens in the row's context (row_id, pos, token_id; its last `block` positions) times the penalty where negative, over it where not."""
    if block is not None:
        newest = Window.partitionBy("row_id").orderBy(F.desc("pos"))
        context = context.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= block)
    seen = context.select("row_id", "token_id").distinct().withColumn("_seen", F.lit(True))
    logit = F.col("logit")
    changed = F.when(F.col("_seen"), F.when(logit < 0, logit * penalty).otherwise(logit / penalty)).otherwise(logit)
    return logits.join(seen, ["row_id", "token_id"], "left").select("row_id", "token_id", changed.alias("logit"))


def temper(logits: DataFrame, temperature: float) -> DataFrame:
    return logits.withColumn("logit", F.col("logit") / max(temperature, 1e-8))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Tokens whose logit is at least the k-th largest of their row: ties stay."""
    place = F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("logit")))
    return logits.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def softmax(logits: DataFrame) -> DataFrame:
    """logits with p. One aggregate a row, joined back: a row's tokens need no task of their own."""
    most = logits.groupBy("row_id").agg(F.max("logit").alias("_most"))
    raised = logits.join(most, "row_id").withColumn("_e", F.exp(F.col("logit") - F.col("_most")))
    total = raised.groupBy("row_id").agg(F.sum("_e").alias("_total"))
    return raised.join(total, "row_id").withColumn("p", F.col("_e") / F.col("_total")).drop("_most", "_e", "_total")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """Tokens before which less than p of their row's probability lies, by descending logit (equal ones by token_id); the best token always."""
    by_logit = Window.partitionBy("row_id").orderBy(F.desc("logit"), "token_id")
    before = F.sum("p").over(by_logit.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("p")
    placed = softmax(logits).withColumn("_before", before).withColumn("_nth", F.row_number().over(by_logit))
    return placed.where((F.col("_before") < p) | (F.col("_nth") == 1)).select(*logits.columns)


def draw(logits: DataFrame, seed: int) -> DataFrame:
    """row_id, token_id drawn by the softmax: the largest logit plus Gumbel noise from a keyed hash. One aggregate a row."""
    u = (F.xxhash64(F.lit(seed), "row_id", "token_id").cast("double") / F.lit(2.0**64) + 0.5).cast("double")
    noise = -F.log(-F.log(F.greatest(F.least(u, F.lit(1 - 1e-12)), F.lit(1e-12))))
    return logits.withColumn("_score", F.col("logit") + noise).groupBy("row_id").agg(F.max_by("token_id", "_score").alias("token_id"))


def sample(logits: DataFrame, context: DataFrame, profile, seed: int, block: int | None = None) -> DataFrame:
    """All rules of a profile, then the draw."""
    if not profile.temperature > 0 or (profile.top_p is not None and not 0 < profile.top_p <= 1) or (profile.top_k is not None and profile.top_k < 1):
        raise ValueError("temperature must be above 0, top_p in (0, 1], top_k at least 1")
    out = temper(penalize(logits, context, profile.penalty, block), profile.temperature)
    out = top_k(out, profile.top_k) if profile.top_k is not None else out
    out = top_p(out, profile.top_p) if profile.top_p is not None else out
    return draw(out, seed)


def generate(context: DataFrame, scorer, profile, *, steps: int, eos: int, block: int, seed: int) -> DataFrame:
    """context (row_id, pos, token_id) with up to `steps` tokens more a row; rows stop at eos.

    scorer(context) gives logits (row_id, token_id, logit) of each row's next token. One job a step: the loop is over
    tokens, never over rows.
    """
    from corpusloom.runtime import materialize

    if steps < 0:
        raise ValueError("steps must not be negative")
    ended = context.select("row_id").distinct().where(F.lit(False))
    for step in range(steps):
        live = context.join(ended, "row_id", "left_anti")
        following = sample(scorer(live), live, profile, seed + step, block)
        at = live.groupBy("row_id").agg((F.max("pos") + 1).alias("pos"))
        new = materialize(following.join(at, "row_id").select("row_id", "pos", "token_id"), "generated")
        context = materialize(context.select("row_id", "pos", "token_id").unionByName(new), "context")
        ended = materialize(ended.unionByName(new.where(F.col("token_id") == eos).select("row_id")), "ended")
        if new.where(F.col("token_id") != eos).isEmpty():
            break
    return context
