"""Progress logs and checkpoint catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.prefix import with_running
from corpusloom.runtime import free_names


def progress_rows(states: DataFrame) -> DataFrame:
    """Log rows of states (step, total_steps, tokens_seen, data_position, loss, best_val_loss, lr, tokens_per_second, vram_gb): rounded, infinity as null, no total as 0.0."""
    best = F.when(F.abs("best_val_loss") < float("inf"), F.round("best_val_loss", 4))
    share = F.when(F.col("total_steps") != 0, F.round(F.col("step") / F.col("total_steps"), 4)).otherwise(F.lit(0.0))
    return states.select("step", "total_steps", share.alias("progress"), "tokens_seen", "data_position", F.round("loss", 4).alias("loss"), best.alias("best_val_loss"), "lr", F.round("tokens_per_second").cast("long").alias("tokens_per_second"), F.round("vram_gb", 2).alias("vram_gb"))


def latest(log: DataFrame, by: list[str], step: str) -> DataFrame:
    """Each run's row of largest step."""
    others = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.max_by(F.struct(*others), step).alias("_row")).select(*by, "_row.*")


def running_best(log: DataFrame, by: list[str], order: list[str], loss: str) -> DataFrame:
    """log with best, the least loss so far, and is_best, whether the row is below all before. The first order column must be a number; a run of very many rows is many tasks."""
    (before,) = free_names([*log.columns, "best", "is_best"], "_before")
    placed = with_running(log, order, by, {before: F.col(loss)}, {})
    out = placed.withColumn("best", F.least(before, loss)).withColumn("is_best", F.col(before).isNull() | (F.col(loss) < F.col(before)))
    return out.drop(before)


def throughput_rows(log: DataFrame, by: list[str], step: str, seconds: Column, tokens_per_step: int) -> DataFrame:
    """log with steps_since, seconds_since and tokens_per_second since each run's row before. step must be a number; a run of very many rows is many tasks."""
    now, at, then = free_names([*log.columns, "steps_since", "seconds_since", "tokens_per_second"], "_now", "_at", "_then")
    out = with_running(log.withColumn(now, seconds), [step], by, {}, {at: F.col(step), then: F.col(now)})
    out = out.withColumn("steps_since", F.col(step) - F.col(at)).withColumn("seconds_since", F.col(now) - F.col(then))
    return out.withColumn("tokens_per_second", F.when(F.col("seconds_since") > 0, tokens_per_step * F.col("steps_since") / F.col("seconds_since"))).drop(now, at, then)


def retained(catalog: DataFrame, by: list[str], keep: int, loss: str) -> DataFrame:
    """The newest `keep` checkpoints (step) of each run and its best one."""
    newest, best = Window.partitionBy(*by).orderBy(F.desc("step")), Window.partitionBy(*by).orderBy(F.col(loss).asc_nulls_last(), "step")
    placed = catalog.withColumn("_new", F.row_number().over(newest)).withColumn("is_best", F.row_number().over(best) == 1)
    return placed.where((F.col("_new") <= keep) | F.col("is_best")).drop("_new")


def latest_loadable(catalog: DataFrame, by: list[str], valid: Column) -> DataFrame:
    """The newest checkpoint of each run that is valid: older ones stand in for broken ones."""
    return latest(catalog.where(valid), by, "step")


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """catalog with rows in place of those of the same step."""
    return catalog.join(rows.select("step"), "step", "left_anti").select(*catalog.columns).unionByName(rows.select(*catalog.columns))


def rebuild(files: DataFrame) -> DataFrame:
    """step, file of a listing (file), by the number in each checkpoint's name."""
    step = F.regexp_extract("file", r"step_(\d+)\.\w+$", 1)
    return files.where(step != "").select(step.cast("long").alias("step"), "file")
