"""Small Arrow helpers for functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings; a null is an empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a chunk's ``column`` holds about ``size`` bytes; one longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(np.nan_to_num(lengths.to_numpy(zero_copy_only=False).astype(float)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list value per numpy array."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int64)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.LargeListArray.from_arrays(offsets, pa.array(flat, kind)).cast(pa.list_(kind))
