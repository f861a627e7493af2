"""Greedy shards of very many rows: the fold over sizes, as jumps over prefix sums.

A shard that starts at a prefix sum p ends where the sums reach p + shard_bytes, so the next one starts at the first
sum from there on. The rows of a group are cut into ranges of sums. Each range tells, for every sum in it at which a
shard might start, where the jumps from there leave the range and how many there are: links that are doubled until all
have left. One walk over the ranges, a lookup a range, then finds the sum at which each range is really entered, and
the ranges number their rows from it, all at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.prefix import with_prefix
from corpusloom.runtime import materialize, ship

#: Rows that a range is meant for, and ranges of a group at the most: the walk takes a lookup for each.
RANGE_ROWS, RANGES = 500_000, 256


def leaps(sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For shards of `size` that start at each of the ascending sums, the sum that the first start beyond them must reach, and how many start among them."""
    n = len(sums)
    link = np.append(np.searchsorted(sums, sums + size), n)
    count, last = np.append(np.ones(n, np.int64), 0), np.append(np.arange(n), n)
    while (link[:n] < n).any():
        inside = link < n
        last = np.where(inside, last[np.minimum(link, n)], last)
        count = count + np.where(inside, count[link], 0)
        link = link[link]
    return sums[last[:n]] + size, count[:n]


def starts_from(sums: np.ndarray, entry: int, size: int) -> np.ndarray:
    """The sums at which shards start among the ascending ones, the first of them at `entry`."""
    out, at = [], int(np.searchsorted(sums, entry))
    while at < len(sums):
        out.append(int(sums[at]))
        at = int(np.searchsorted(sums, out[-1] + size))
    return np.array(out, np.int64)


def shard_of_rows(sizes: DataFrame, *, first: int, shard_bytes: int) -> DataFrame:
    """g, o, shard of rows (g, o: a number, b: bytes), one for each g and o: within g, in the order of o (null first), a shard closes once it holds shard_bytes.

    g may be null, which is a group. The driver holds a row for each group and range.
    """
    spark = sizes.sparkSession
    ship(spark)
    totals = sizes.groupBy("g").agg(F.count("*").alias("n"), F.sum("b").alias("total"))
    ranges = F.least(F.lit(RANGES), F.ceil(F.col("n") / RANGE_ROWS))
    widths = materialize(totals.select(F.col("g").alias("own"), F.greatest(F.lit(4 * shard_bytes), F.ceil(F.col("total") / ranges) + 1).cast("long").alias("width")), "shard-widths")
    if not widths.take(1):
        return sizes.select("g", "o", F.lit(first).alias("shard"))
    placed = with_prefix(sizes, ["o"], {"at": F.col("b")}, ["g"]).select("g", "o", F.col("at").cast("long").alias("at"))
    placed = placed.join(widths, F.col("g").eqNullSafe(F.col("own"))).select("g", "o", "at", F.expr("cast(at div width as int)").alias("part"))
    placed = materialize(placed, "shard-sums")
    kind = dict(placed.dtypes)["g"]

    def jump(group: pa.Table) -> pa.Table:
        sums = np.unique(group["at"].to_numpy())
        leave, count = leaps(sums, shard_bytes)
        own = group["g"].combine_chunks().take(pa.array(np.zeros(len(sums), np.int64)))
        return pa.table({"g": own, "part": pa.array(np.full(len(sums), group["part"][0].as_py()), pa.int32()), "at": pa.array(sums), "leave": pa.array(leave), "jumps": pa.array(count)})

    # sorted files: a lookup reads the row groups that hold its sums
    links = placed.groupBy("g", "part").applyInArrow(jump, f"g {kind}, part int, at long, leave long, jumps long")
    links = materialize(links.sortWithinPartitions("part", "at"), "shard-links")
    waiting = [(r.g, 0) for r in widths.select(F.col("own").alias("g")).collect()]
    entered: list[tuple] = []  # group, range, first start in it, starts before it, starts up to its end
    before = {g: 0 for g, _ in waiting}
    while waiting:
        asked = spark.createDataFrame(waiting, f"own {kind}, reach long")
        met = links.where(F.col("at") >= min(x for _, x in waiting)).join(F.broadcast(asked), F.col("g").eqNullSafe(F.col("own")) & (F.col("at") >= F.col("reach")))
        found = met.groupBy("g").agg(F.min(F.struct("at", "part", "leave", "jumps")).alias("s")).select("g", "s.*").collect()
        for r in found:
            entered.append((r.g, r.part, r.at, before[r.g], before[r.g] + r.jumps))
            before[r.g] += r.jumps
        waiting = [(r.g, r.leave) for r in found]
    entries = spark.createDataFrame(entered, f"own {kind}, from_part int, entry long, before long, upto long")
    parts = placed.select("g", "part").distinct()
    latest = parts.join(F.broadcast(entries), F.col("g").eqNullSafe(F.col("own")) & (F.col("from_part") <= F.col("part")))
    latest = latest.groupBy("g", "part").agg(F.max(F.struct("from_part", "entry", "before", "upto")).alias("s")).select(F.col("g").alias("own"), F.col("part").alias("own_part"), "s.*")
    known = placed.join(latest, F.col("g").eqNullSafe(F.col("own")) & (F.col("part") == F.col("own_part"))).select("g", "o", "at", "part", "from_part", "entry", "before", "upto")

    def number(group: pa.Table) -> pa.Table:
        at = group["at"].to_numpy()
        part, from_part, entry, held, upto = (group[c][0].as_py() for c in ("part", "from_part", "entry", "before", "upto"))
        if from_part == part:  # rows before the first start belong to the shard before
            nth = held - 1 + np.searchsorted(starts_from(np.unique(at), entry, shard_bytes), at, "right")
        else:  # no shard starts here
            nth = np.full(len(at), upto - 1)
        return pa.table({"g": group["g"], "o": group["o"], "shard": pa.array((first + nth).astype(np.int32))})

    return known.groupBy("g", "part").applyInArrow(number, f"g {kind}, o {dict(placed.dtypes)['o']}, shard int")
