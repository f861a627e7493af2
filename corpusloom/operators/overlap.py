"""Checks that held-out texts and prompts are not in the training corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.hashing import md5_hash
from corpusloom.functions.text import normalize_text, prefix
from corpusloom.operators.seeds import containing


def hashed(docs: DataFrame, order: str) -> DataFrame:
    """order, h, lead of the documents that are not empty after normalisation."""
    norm = docs.select(order, normalize_text(F.col("text")).alias("norm")).where(F.col("norm") != "")
    return norm.select(order, md5_hash(F.col("norm")).alias("h"), prefix(F.col("norm"), 160).alias("lead"))


def overlap_report(evaluation: DataFrame, train: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row: documents and distinct texts of the evaluation set, its own duplicates, texts that train has too, train documents, up to 5 examples in train order, and whether the set is clean."""
    ours, theirs = hashed(evaluation, order), hashed(train, order)
    distinct = ours.groupBy("h").agg(F.min_by("lead", order).alias("lead"))
    met = theirs.groupBy("h").agg(F.min(order).alias("at")).join(distinct, "h")
    shared = met.agg(F.count("*").alias("n_overlap"))
    examples = met.orderBy("at").limit(5).agg(F.sort_array(F.collect_list(F.struct("at", "lead"))).alias("e")).select(F.col("e.lead").alias("examples"))
    counts = ours.agg(F.count("*").alias("n_eval"), F.countDistinct("h").alias("n_distinct"))
    one = counts.crossJoin(shared).crossJoin(examples).crossJoin(theirs.agg(F.count("*").alias("n_train")))
    clean = (F.col("n_eval") > 0) & (F.col("n_eval") == F.col("n_distinct")) & (F.col("n_overlap") == 0)
    return one.select("n_eval", "n_distinct", (F.col("n_eval") - F.col("n_distinct")).alias("n_internal"), "n_overlap", "n_train", "examples", clean.alias("clean"))


def require_clean(report: DataFrame) -> None:
    """Raise at the first thing that is wrong with an evaluation set: empty, repeats itself, or shares texts with train."""
    row = report.first()
    if not row.n_eval:
        raise ValueError("the evaluation set is empty")
    if row.n_internal:
        raise ValueError(f"the evaluation set repeats {row.n_internal} of its texts")
    if row.n_overlap:
        raise ValueError(f"CONTAMINATION: {row.n_overlap} texts of the evaluation set are in the training corpus")


def contains_hits(needles: DataFrame, docs: DataFrame, key: str = "item_id") -> DataFrame:
    """key, hits, n_docs: how many documents contain each needle's normalised text.

    Needles of any number and length are found by a join of seeds (seeds.py). Needles that are empty after
    normalisation are left out; equal needles have equal hits; null and empty texts contain nothing.
    """
    asked = needles.select(key, normalize_text(F.col("text")).alias("needle")).where("needle <> ''")
    found = containing(asked, docs.select(normalize_text(F.col("text")).alias("norm")))
    scanned = docs.agg(F.count("*").alias("n_docs"))
    return asked.join(found, "needle", "left").crossJoin(scanned).select(key, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "n_docs")


def require_unseen(needles: DataFrame, docs: DataFrame, key: str = "item_id") -> int:
    """The number of documents; raise where there are none or where any contains a needle's normalised text."""
    n_docs = docs.count()
    if not n_docs:
        raise ValueError("the training corpus has no documents")
    met = contains_hits(needles, docs, key).where("hits > 0").orderBy(key).collect()
    if met:
        raise ValueError("CONTAMINATION: prompts in the training corpus: " + ", ".join(f"{r[key]}={r.hits}" for r in met))
    return n_docs


def prompt_overlap(final: DataFrame, diagnostic: DataFrame, key: str) -> DataFrame:
    """Keys of the final prompts whose normalised text a diagnostic prompt has too."""
    other = diagnostic.select(normalize_text(F.col("text")).alias("norm")).distinct()
    return final.select(key, normalize_text(F.col("text")).alias("norm")).join(other, "norm", "left_semi").select(key)


def prompt_faults(prompts: DataFrame) -> DataFrame:
    """fault, value of a prompt table (id, group, text): empty fields, repeated ids, repeated texts."""
    norm = prompts.withColumn("norm", normalize_text(F.coalesce("text", F.lit(""))))
    blank = norm.where((F.coalesce(F.btrim("id"), F.lit("")) == "") | (F.coalesce(F.btrim("group"), F.lit("")) == "") | (F.col("norm") == ""))
    ids = norm.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("fault"), F.col("id").alias("value"))
    texts = norm.where("norm <> ''").groupBy("norm").count().where("count > 1").select(F.lit("repeated text").alias("fault"), F.col("norm").alias("value"))
    return blank.select(F.lit("empty field").alias("fault"), F.coalesce("id", F.lit("")).alias("value")).unionByName(ids).unionByName(texts)
