"""Document hashes and the split they decide."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def md5_hash(text: Column) -> Column:
    """Native content hash, hex."""
    return F.md5(text.cast("binary"))


@F.pandas_udf(StringType())
def blake2b_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BLAKE2b with 16 bytes of digest, hex; neither Spark nor DuckDB has it built in."""
    for batch in batches:
        yield batch.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest())


def split_of(digest: Column, val_ratio: float) -> Column:
    """val where the first 8 hex digits, as a share of 2^32, are below val_ratio; else train."""
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    return F.when(share < val_ratio, "val").otherwise("train")


def fingerprint_json(value) -> str:
    """BLAKE2b-128 of JSON with sorted keys and no spare white space."""
    return hashlib.blake2b(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode(), digest_size=16).hexdigest()


def run_id(checkpoint: str, suite: str) -> str:
    """Short deterministic name of an evaluation run."""
    return hashlib.blake2b(f"{checkpoint}:{suite}".encode(), digest_size=6).hexdigest()
