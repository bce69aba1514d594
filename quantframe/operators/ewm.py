"""Exponentially weighted means as scaled running sums over bounded pieces.

With ``b = 1 - 2 / (span + 1)`` the weighted sum ``N_t = sum_j u_j * b**(t - j)`` inside a piece is
``b**p * running_sum(u * b**-p)``.  Terms whose weight is below ``2**-60`` cannot change a double,
so a piece that starts ``reach(span)`` rows early needs no carry from before it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.operators.timeline import halo_blocks

MAX_EXPONENT = 600.0  # keeps b**-p below exp(600), well inside double range


def decay(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def reach(span: float) -> int:
    """Rows after which a weight is below 2**-60."""
    return max(1, math.ceil(60 * math.log(2) / -math.log(decay(span))))


def fits(span: float, rows: int) -> bool:
    """Whether a scaled sum over ``rows`` rows stays in double range."""
    return rows * -math.log(decay(span)) < MAX_EXPONENT


def seed_weight(value: Column, span: float, adjust: bool, ordinal: Column) -> Column:
    """Input term: without adjustment the first value of the series weighs 1, the others alpha."""
    if adjust:
        return value
    return F.when(ordinal == 1, value / F.lit(1.0 - decay(span))).otherwise(value)


def finish(weighted: Column, span: float, adjust: bool, ordinal: Column) -> Column:
    b = decay(span)
    if adjust:
        return weighted * F.lit(1.0 - b) / (F.lit(1.0) - F.pow(F.lit(b), ordinal))
    return weighted * F.lit(1.0 - b)


def scaled(value: Column, span: float, position: Column, window: Window) -> Column:
    """``sum_j u_j * b**(p - j)`` over the window's running frame."""
    b = F.lit(decay(span))
    frame = window.rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value * F.pow(b, -position)).over(frame) * F.pow(b, position)


def ewm(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    value: str,
    span: float,
    adjust: bool = True,
    name: str = "ewm",
    block: int | None = None,
) -> DataFrame:
    """``value.ewm(span, adjust).mean()`` per key; ``ordinal`` is the dense 1-based position."""
    halo = reach(span)
    block = block or max(8 * halo, 4096)
    if not fits(span, block + halo):  # short spans: the shortest block whose scaled sums stay in range
        block = 8 * halo
    if block < halo:
        raise ValueError(f"span {span} needs blocks of at least {halo} rows")
    blocks = halo_blocks(df, keys, ordinal, block, halo, lead=False)
    window = Window.partitionBy(*keys, "_blk").orderBy(ordinal)
    position = F.col(ordinal)
    term = seed_weight(F.col(value), span, adjust, position)
    total = scaled(term, span, F.col("_p"), window)
    return (
        blocks.withColumn(name, finish(total, span, adjust, position))
        .filter("_own")
        .drop("_blk", "_own", "_p")
    )
