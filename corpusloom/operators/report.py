"""Release report of two measured artifacts, and its gates."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOSS = ("n_docs", "n_tokens", "nll", "perplexity")
GENERATION = ("n_samples", "eos_rate", "distinct_1_mean", "distinct_2_mean", "distinct_4_mean", "max_4gram_repeat")


def only_file(folder: str, pattern: str) -> str:
    """The one file that a pattern finds."""
    found = sorted(Path(folder).glob(pattern))
    if len(found) != 1:
        raise ValueError(f"{pattern}: {len(found)} files in {folder}, wanted one")
    return str(found[0])


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object as one row."""
    out = spark.read.json(path, multiLine=True)
    if "_corrupt_record" in out.columns or out.count() != 1:
        raise ValueError(f"{path} is not one JSON object")
    return out


def gates(generation: DataFrame, loss: DataFrame, *, step: int, checkpoint: str) -> DataFrame:
    """gate, passed: every condition that a release report needs."""
    g, r = generation.select(F.struct("*").alias("g")), loss.select(F.struct("*").alias("r"))
    one = g.crossJoin(r)
    checks = {
        "generation is final": (F.col("g.purpose") == "final") & F.col("g.eligible_for_final_claims"),
        "generation was not used for tuning": ~F.col("g.used_for_sampling_tuning"),
        "prompts are not in the corpus": F.col("g.contamination.exact_prompt_hits") == 0,
        "generation is of the checkpoint": (F.col("g.run.checkpoint_step") == step) & (F.col("g.run.checkpoint_fingerprint") == checkpoint),
        "loss is final": (F.col("r.purpose") == "final_human_loss") & F.col("r.eligible_for_final_claims"),
        "loss is of the checkpoint": (F.col("r.checkpoint_step") == step) & (F.col("r.checkpoint_fingerprint") == checkpoint),
        "held-out texts are not in the corpus": F.col("r.separation.n_overlap") == 0,
        "one tokenizer": F.col("g.run.tokenizer_fingerprint") == F.col("r.tokenizer_fingerprint"),
        **{f"loss has {c}": F.col(f"r.result.{c}").try_cast("double").isNotNull() for c in LOSS},
        **{f"generation has {c}": F.col(f"g.summary.{c}").try_cast("double").isNotNull() for c in GENERATION},
    }
    listed = F.array(*[F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed")) for name, ok in checks.items()])
    return one.select(F.explode(listed).alias("x")).select("x.gate", "x.passed")


def release_report(generation: DataFrame, loss: DataFrame, *, step: int, checkpoint: str) -> DataFrame:
    """One row of both artifacts' figures; raises with the gates that fail."""
    failed = [r.gate for r in gates(generation, loss, step=step, checkpoint=checkpoint).where("not passed").collect()]
    if failed:
        raise ValueError("gates not passed: " + "; ".join(failed))
    g = generation.select("summary.*").select(*GENERATION)
    r = loss.select(F.col("tokenizer_fingerprint"), "result.*").select("tokenizer_fingerprint", *LOSS)
    return r.crossJoin(g).withColumn("checkpoint_step", F.lit(step)).withColumn("checkpoint_fingerprint", F.lit(checkpoint))


def render_markdown(row) -> str:
    lines = ["| Metric | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in row.asDict().items())]
    return "\n".join(lines) + "\n"


def require_outside(source: str, output: str, corpus: str) -> None:
    """Raise where a held-out output would overwrite its source or fall into the corpus."""
    a, b, c = (os.path.realpath(x) for x in (source, output, corpus))
    if a == b:
        raise ValueError("source and output are the same file")
    if os.path.commonpath([b, c]) == c:
        raise ValueError("the output lies inside the corpus")


def require_provenance(confirmed: bool, **fields: str) -> None:
    """Raise unless a person confirmed the held-out set and every provenance field is given."""
    if not confirmed:
        raise ValueError("the held-out set needs explicit confirmation")
    if blank := [k for k, v in fields.items() if not (v or "").strip()]:
        raise ValueError("missing provenance: " + ", ".join(blank))


def require_match(what: str, wanted: str | None, *found: str | None) -> int:
    """Place of the first fingerprint that is there (a checkpoint's, then the data's); raises if it is another one."""
    for i, value in enumerate(found):
        if value is not None:
            if value != wanted:
                raise ValueError(f"{what}: fingerprint {value}, wanted {wanted}")
            return i
    raise ValueError(f"{what}: no fingerprint")


def require_new(path: str) -> None:
    """Raise where a run-once output exists already."""
    if os.path.exists(path):
        raise FileExistsError(path)
