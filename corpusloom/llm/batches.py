"""Arrow batches of texts in pieces of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker turns into Python objects at once; a longer text comes alone.
TOGETHER = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices whose texts take about `most` bytes; a batch without rows is left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice, null as empty."""
    return [t or "" for t in batch[column].to_pylist()]
