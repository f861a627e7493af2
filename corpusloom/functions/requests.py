"""Checks of generation requests that arrive as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "n_tokens long, temperature double, top_p double, top_k long, penalty double"


def sanitize(requests: DataFrame) -> DataFrame:
    """requests (request) with their known fields held within bounds, and fault where one cannot be: unknown fields are dropped, absent ones null."""
    out = requests.withColumn("_r", F.from_json("request", SCHEMA))
    p, k, r = F.col("_r.top_p"), F.col("_r.top_k"), F.col("_r.penalty")
    fault = F.when(~p.between(0, 1), "top_p outside [0, 1]").when(k < 1, "top_k below 1").when(r < 1, "penalty below 1")
    clamp = F.when(F.col("_r.n_tokens").isNotNull(), F.greatest(F.lit(1), F.least(F.col("_r.n_tokens"), F.lit(1000))))
    warm = F.when(F.col("_r.temperature").isNotNull(), F.greatest(F.lit(0.01), F.col("_r.temperature")))
    return out.withColumns({"n_tokens": clamp.cast("long"), "temperature": warm, "top_p": p, "top_k": k, "penalty": r, "fault": fault}).drop("_r")
