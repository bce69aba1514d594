"""Lags, sliding sums and running sums over sorted blocks, all of them in one pass.

A window of Spark copies every row it sees and reads the copies again for each frame, which costs far more than the sums
themselves when a panel has dozens of frames.  Here the rows of a block, which the caller has brought together and sorted, pass
once through numpy.  A task holds one block at a time.  Sums add the oldest row first and skip nulls, as Spark's do.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Series = tuple[np.ndarray, np.ndarray]  # values, and where they are not null
#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 8192


class Step(NamedTuple):
    """One result: ``kind`` (a key of ``KINDS``) of ``column`` with size ``n``; ``zero`` makes nulls of it, or of its lags, 0."""

    kind: str
    column: str
    n: int = 0
    by: str | int = ""
    zero: bool = False


def _shift(x: Series, n: int) -> Series:
    value, known = np.zeros_like(x[0]), np.zeros_like(x[1])
    kept = max(len(value) - abs(n), 0)
    there, here = (slice(0, kept), slice(len(value) - kept, None)) if n >= 0 else (slice(len(value) - kept, None), slice(0, kept))
    value[here], known[here] = x[0][there], x[1][there]
    return value, known


def _frame(x: Series, n: int) -> Iterator[Series]:
    """The rows of each row's frame of ``n`` rows, the oldest first."""
    return (_shift(x, k) for k in range(n - 1, -1, -1))


def _lag(x: Series, step: Step, _) -> Series:
    return _shift(x, step.n)


def _count(x: Series, step: Step, _) -> Series:
    return sum(known.astype(float) for _, known in _frame(x, step.n)), np.ones(len(x[0]), bool)


def _sum(x: Series, step: Step, _) -> Series:
    total, any_ = np.zeros(len(x[0])), np.zeros(len(x[0]), bool)
    for value, known in _frame(x, step.n):
        total, any_ = total + np.where(known, value, 0.0), any_ | known
    return total, any_ | step.zero


def _mean(x: Series, step: Step, _) -> Series:
    total, any_ = _sum(x, step, None)
    return total / np.maximum(_count(x, step, None)[0], 1), any_


def _std(x: Series, step: Step, _) -> Series:
    """Sample deviation by updates of mean and squared distance."""
    n, mean, square = np.zeros(len(x[0])), np.zeros(len(x[0])), np.zeros(len(x[0]))
    for value, known in _frame(x, step.n):
        n = n + known
        delta = np.where(known, value - mean, 0.0)
        part = delta / np.maximum(n, 1)
        mean, square = mean + part, square + delta * (delta - part)
    return np.sqrt(square / np.maximum(n - 1, 1)), n > 1


def _steps(x: Series, step: Step, _) -> Series:
    """Sum over ``n`` rows from sums over ``by`` rows."""
    total, all_ = x
    for k in range(step.by, step.n, step.by):
        value, known = _shift(x, k)
        total, all_ = total + np.where(known, value, 0.0), all_ & (known | step.zero)
    return total, all_


def _running(x: Series, step: Step, columns: Mapping[str, Series]) -> Series:
    """Sum from the first row on, or from where the column ``by`` last changed."""
    value, known = np.where(x[1], x[0], 0.0), x[1]
    edges = [0, *(np.flatnonzero(np.diff(columns[step.by][0])) + 1)] if step.by else [0]
    total, any_ = np.empty_like(value), np.empty_like(known)
    for a, b in pairwise([*edges, len(value)]):
        total[a:b], any_[a:b] = np.cumsum(value[a:b]), np.logical_or.accumulate(known[a:b])
    return total, any_


def _carried(x: Series, step: Step, columns: Mapping[str, Series]) -> Series:
    """The last known value, before this row, of a row whose column ``by`` is ``n``."""
    at, there = columns[step.by]
    last = np.maximum.accumulate(np.where((at == step.n) & there & x[1], np.arange(len(at)), -1))
    last = np.concatenate([[-1], last[:-1]])
    return x[0][last], last >= 0


KINDS = {"lag": _lag, "count": _count, "sum": _sum, "mean": _mean, "std": _std, "steps": _steps, "running": _running, "carried": _carried}


def _blocks(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = np.arange(batch.num_rows) == 0
        for key in keys:
            codes = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begins[1:] |= codes[1:] != codes[:-1]
        for a, b in pairwise([*np.flatnonzero(begins), batch.num_rows]):
            piece = batch.slice(a, b - a)
            own = [piece.column(key)[0].as_py() for key in keys]
            if held and own != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
            last = own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _series(column: pa.ChunkedArray) -> Series:
    column = column.cast(pa.float64())
    return column.fill_null(0.0).to_numpy(), column.is_valid().to_numpy()


def slide(df: DataFrame, keys: Sequence[str], steps: Mapping[str, Step]) -> DataFrame:
    """Add a double column per step; a step may read the columns of those before it.

    Rows with equal ``keys`` must lie in one partition, one after the other and in order; they stay so.
    Columns whose names begin with two underscores are there for the steps only and do not come back.
    """
    keys, steps = list(keys), dict(steps)
    fields = [*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in steps]]
    schema = T.StructType([f for f in fields if not f.name.startswith("__")])
    read = {c for s in steps.values() for c in (s.column, s.by) if c and isinstance(c, str)} - set(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, keys):
            columns = {name: _series(block.column(name)) for name in read}
            for name, step in steps.items():
                columns[name] = KINDS[step.kind](columns[step.column], step, columns)
            added = {name: pa.array(columns[name][0], pa.float64(), mask=~columns[name][1]) for name in steps if not name.startswith("__")}
            given = {name: block.column(name) for name in block.column_names if name in schema.names}
            yield from pa.table({**given, **added}).to_batches(max_chunksize=BATCH_ROWS)

    return df.mapInArrow(run, schema)
