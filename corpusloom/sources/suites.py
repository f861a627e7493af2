"""Prompt suites: JSON objects with nested prompts and the marks that lock them."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import DEFAULT_PROFILE, SamplingProfile
from corpusloom.functions.hashing import fingerprint_json
from corpusloom.operators.overlap import prompt_faults

SCHEMA = "purpose string, used_for_sampling_tuning boolean, eligible_for_final_claims boolean, run_config_fingerprint string, prompts array<struct<id: string, `group`: string, text: string>>"


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """id, group, text of a diagnostic suite; raises at empty fields and repeated ids or texts."""
    suite = spark.read.schema(SCHEMA).json(path, multiLine=True)
    prompts = suite.select(F.explode("prompts").alias("p")).select("p.id", "p.group", "p.text")
    if faults := prompt_faults(prompts).limit(5).collect():
        raise ValueError("; ".join(f"{f.fault}: {f.value}" for f in faults))
    if prompts.isEmpty():
        raise ValueError("the suite has no prompts")
    return prompts


def read_diagnostic_suite(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a suite that tuning may use and final claims may not; raises where its marks say otherwise."""
    head = spark.read.schema(SCHEMA).json(path, multiLine=True).drop("prompts").first()
    if head is None or head.purpose != "diagnostic" or head.eligible_for_final_claims is not False or head.used_for_sampling_tuning is not True:
        raise ValueError("the suite is not marked as a diagnostic one")
    return read_suite(spark, path)


def run_spec(*, checkpoint_step: int, checkpoint_fingerprint: str, seeds: tuple[int, ...], max_new: int, profile: SamplingProfile = DEFAULT_PROFILE) -> dict:
    """What a final generation run is made of, and its fingerprint, to which a final suite is locked."""
    if max_new < 0 or not seeds:
        raise ValueError("a run needs seeds and no negative number of tokens")
    spec = {"checkpoint_step": checkpoint_step, "checkpoint_fingerprint": checkpoint_fingerprint, "seeds": list(seeds), "profile": asdict(profile), "max_new": max_new}
    return spec | {"fingerprint": fingerprint_json(spec)}


def read_final_suite(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Prompts of a locked suite: final, never used for tuning, of this run configuration."""
    head = spark.read.schema(SCHEMA).json(path, multiLine=True).drop("prompts").first()
    if head is None or head.purpose != "final" or head.used_for_sampling_tuning is not False or head.eligible_for_final_claims is not True:
        raise ValueError("the suite is not locked for final claims")
    if head.run_config_fingerprint != fingerprint:
        raise ValueError("the suite is locked to another run configuration")
    return read_suite(spark, path)


def read_locked(spark: SparkSession, path: str, *, purpose: str, fingerprint: str):
    """A metadata row whose purpose, marks and fingerprint are as they must be."""
    schema = "purpose string, used_for_training boolean, used_for_sampling_tuning boolean, eligible_for_final_claims boolean, fingerprint string"
    row = spark.read.schema(schema).json(path, multiLine=True).first()
    if row is None or row.purpose != purpose or row.used_for_training or row.used_for_sampling_tuning or not row.eligible_for_final_claims or row.fingerprint != fingerprint:
        raise ValueError("the metadata is not locked as it must be")
    return row
