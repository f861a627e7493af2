"""Repetition metrics and their human-written ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import HUMAN_RANGES
from corpusloom.functions.text import distinct_n, joined_ngrams, words
from corpusloom.operators.prefix import with_prefix
from corpusloom.runtime import materialize


def max_repeat(tokens: Column, n: int = 4) -> Column:
    """How often the commonest n-gram occurs, 0 if there is none: the longest run of equal ones among the sorted n-grams."""
    grams = F.sort_array(joined_ngrams(tokens, n))
    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state, gram):
        run = F.when(state["gram"] == gram, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(gram.alias("gram"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(grams, start, step, lambda s: s["most"])


def metrics(tokens: Column) -> dict[str, Column]:
    """distinct_1, distinct_2, distinct_4, max_4gram, n_words of a text's words; zeros for none.

    tokens must be a column, not an expression: n-grams read it once for each place.
    """
    return {**{f"distinct_{n}": distinct_n(tokens, n) for n in (1, 2, 4)}, "max_4gram": max_repeat(tokens), "n_words": F.size(tokens)}


def human_range(n_words: Column) -> tuple[Column, Column, Column]:
    """p10, median, p90 of the first length not below n_words, of the last one beyond."""
    def column(i: int) -> Column:
        out = None
        for row in HUMAN_RANGES[:-1]:
            out = F.when(n_words <= row[0], row[i]) if out is None else out.when(n_words <= row[0], row[i])
        return out.otherwise(HUMAN_RANGES[-1][i])

    return column(1), column(2), column(3)


def in_range(distinct_2: Column, n_words: Column) -> Column:
    low, _, high = human_range(n_words)
    return distinct_2.between(low, high)


def label(distinct_2: Column, n_words: Column, *, short: bool = True) -> Column:
    """too short, repeating, unusually diverse, in range; without `short` the first is not told."""
    low, _, high = human_range(n_words)
    rest = F.when(distinct_2 < low, "repeating").when(distinct_2 > high, "unusually diverse").otherwise("in range")
    return F.when(n_words < 2, "too short").otherwise(rest) if short else rest


def summary(samples: DataFrame, profile: str, eos: Column) -> DataFrame:
    """For each profile: samples, share that ended, mean distinct-1/2/4, largest 4-gram repeat."""
    split = samples.withColumns({"_words": words(F.col("text")), "_eos": eos.cast("double")})
    measured = split.withColumns(metrics(F.col("_words")))
    return measured.groupBy(profile).agg(
        F.count("*").alias("n_samples"),
        F.round(F.avg("_eos"), 9).alias("eos_rate"),
        *[F.round(F.avg(f"distinct_{n}"), 9).alias(f"distinct_{n}_mean") for n in (1, 2, 4)],
        F.max("max_4gram").cast("long").alias("max_4gram_repeat"),
    )


def percentiles(docs: DataFrame) -> DataFrame:
    """p10, median and p90 of distinct-2 by length class: what the published ranges are for human-written text.

    Exact, by rank: the values are cut into ranges that are sorted each on its own, and a class's size says which ranks
    its percentiles lie between, so that no task holds a class.
    """
    split = docs.select(words(F.col("text")).alias("w"))
    # texts of one word have no pair: null, which percentiles pass over; a filter would split every text twice
    measured = split.select(F.when(F.size("w") >= 2, distinct_n(F.col("w"), 2)).alias("d"), F.size("w").alias("n"))
    bound = None
    for row in HUMAN_RANGES[:-1]:
        bound = F.when(F.col("n") <= row[0], row[0]) if bound is None else bound.when(F.col("n") <= row[0], row[0])
    classed = materialize(measured.select(bound.otherwise(HUMAN_RANGES[-1][0]).cast("long").alias("max_words"), "d"), "distinct-2").where("d is not null")
    return ranked_percentiles(classed, "max_words", "d", {"p10": 0.1, "median": 0.5, "p90": 0.9})


def ranked_percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, n_docs and the wanted percentiles (interpolated, 9 digits) of the values (numbers, not null) of each group; groups are few."""
    placed = with_prefix(rows.select(by, value), [value], {"nth": F.lit(1)}, [by])
    sizes = rows.groupBy(by).agg(F.count("*").alias("n_docs"))
    met = placed.join(sizes, by)
    place = {name: (F.col("n_docs") - 1) * F.lit(share) for name, share in shares.items()}
    at = lambda rank: F.max(F.when(F.col("nth") == rank, F.col(value)))
    ends = [c for name, x in place.items() for c in (at(F.floor(x)).alias(f"{name}_low"), at(F.ceil(x)).alias(f"{name}_high"), F.max(x - F.floor(x)).alias(f"{name}_part"))]
    wanted = met.where(F.array_contains(F.array(*[r.cast("long") for x in place.values() for r in (F.floor(x), F.ceil(x))]), F.col("nth").cast("long")))
    found = wanted.groupBy(by, "n_docs").agg(*ends)
    return found.select(by, "n_docs", *[F.round(F.col(f"{n}_low") * (1 - F.col(f"{n}_part")) + F.col(f"{n}_high") * F.col(f"{n}_part"), 9).alias(n) for n in shares])
