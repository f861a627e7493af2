"""Running sums, least values and rows before, over a whole table without sorting it in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import free_names, materialize

#: Rows that a task of with_running sorts, as far as its hashing deals them evenly: 100 to 150 MB of a run log. A task of fewer than FEW_ROWS is not worth its start.
TASK_ROWS, FEW_ROWS = 1_000_000, 50_000


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most value: first by the first one of each stretch, then within its stretch, so that a row is compared with few of very many bounds."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    stretches = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    listed = lambda x: F.array(*[F.lit(float(b)) for b in x])
    upto = lambda x: F.size(F.filter(x, lambda b: b <= value))
    if len(stretches) == 1:
        return upto(listed(bounds))
    stretch = upto(listed([s[0] for s in stretches[1:]]))
    return stretch * width + upto(F.element_at(F.array(*map(listed, stretches)), stretch + 1))


def _range(df: DataFrame, order: str, least: int = 1) -> Column:
    """The number of a row's range of the order column: its quantiles cut it into as many as the session has shuffle partitions, `least` at least; -1 for null."""
    ranges = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # an error well below a range's share, or ranges would not get smaller as they get more
    bounds = df.approxQuantile(order, [i / ranges for i in range(1, ranges)], min(0.001, 1 / (4 * ranges))) if ranges > 1 else []
    at = _range_of(F.col(order).cast("double"), sorted(set(bounds)))
    return F.coalesce(F.when(F.col(order).isNull(), F.lit(-1)).otherwise(at), F.lit(-1))


def with_running(df: DataFrame, order: list[str], by: list[str], least: dict[str, Column], last: dict[str, Column]) -> DataFrame:
    """df with, for each name in least, the smallest value of all rows before, and for each in last, the value of the row before; null where there is none.

    Each group is a sequence of its own, in the order of the columns, the first of which must be a number (nulls come
    first). As in with_prefix, a group's rows are cut into ranges: each range is scanned on its own and takes what the
    ranges before it hand on, their least values and their last row. A group of very many rows is many tasks. Ranges and
    tasks are counted by rows: partitions that are merged by their compressed bytes would be sorted in far more memory.
    """
    df = df.select("*")
    rows_in = df.count()
    most = -(-rows_in // TASK_ROWS)
    tasks = max(1, most, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows_in // FEW_ROWS)))
    (part,) = free_names([*df.columns, *least, *last], "_range")
    values = dict(zip([*least, *last], free_names([*df.columns, *least, *last, part], *[f"_in_{name}" for name in [*least, *last]]), strict=True))
    placed = materialize(df.withColumns({values[n]: c for n, c in (least | last).items()}).withColumn(part, _range(df, order[0], most)), "ranged")
    keys = free_names([*placed.columns, *least, *last], *[f"_by_{c}" for c in by], "_part")
    handed = free_names([*placed.columns, *keys, *least, *last], *[f"_from_{name}" for name in values])
    # the last row of a range by all order columns; of rows that tie in them any may be the last, as in a window
    found = [F.min(values[n]).alias(h) for n, h in zip(least, handed)] + [F.max_by(F.struct(values[n]), F.struct(*order)).alias(h) for n, h in zip(last, handed[len(least) :])]
    ends = placed.groupBy(*by, part).agg(*found)
    before = Window.partitionBy(*by).orderBy(part)
    carried = [F.min(h).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(h) for h in handed[: len(least)]]
    carried += [F.lag(h).over(before)[values[n]].alias(h) for n, h in zip(last, handed[len(least) :])]
    ends = materialize(ends.select(*[F.col(c).alias(k) for c, k in zip([*by, part], keys, strict=True)], *carried), "handed-on")
    same = F.col(part) == F.col(keys[-1])
    for c, k in zip(by, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    rows = Window.partitionBy(*by, part).orderBy(*order)
    behind, first = rows.rowsBetween(Window.unboundedPreceding, -1), F.row_number().over(rows) == 1
    mins = [F.least(F.col(h), F.min(values[n]).over(behind)).alias(n) for n, h in zip(least, handed)]
    lasts = [F.when(first, F.col(h)).otherwise(F.lag(values[n]).over(rows)).alias(n) for n, h in zip(last, handed[len(least) :])]
    return placed.join(ends, same).repartition(tasks, *by, part).select(*df.columns, *mins, *lasts)


def with_prefix(df: DataFrame, order: list[str], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of its value over all rows before (0 for the first), in the order of the columns.

    The first order column must be a number. Its quantiles cut the rows into ranges that are sorted each on its own;
    the ranges' totals, a small table of a row a range, place them behind one another. by: sums start anew in each
    group. Nulls come first.
    """
    at = _range(df, order[0])
    by = by or []
    part, other, *values = free_names(df.columns + list(sums), "_range", "_r", *[f"_{name}" for name in sums])
    totals_of, offset_of, by_of = (free_names(df.columns + list(sums) + [part, other, *values], *[f"_{kind}_{i}" for i in range(max(len(sums), len(by)))]) for kind in ("total", "offset", "by"))
    placed = df.withColumns(dict(zip(values, sums.values(), strict=True))).withColumn(part, at)
    totals = placed.groupBy(*by, part).agg(*[F.sum(v).alias(t) for v, t in zip(values, totals_of)])
    behind = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select(*by, F.col(part), *[F.coalesce(F.sum(t).over(behind), F.lit(0)).alias(o) for _, t, o in zip(values, totals_of, offset_of)]), "offsets")
    offsets = offsets.select(*[F.col(c).alias(b) for c, b in zip(by, by_of)], F.col(part).alias(other), *offset_of[: len(values)])
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col(part) == F.col(other)
    for c, b in zip(by, by_of):
        same = same & F.col(c).eqNullSafe(F.col(b))
    joined = placed.join(offsets, same)
    return joined.select(*df.columns, *[(F.col(o) + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(name) for name, v, o in zip(sums, values, offset_of)])
