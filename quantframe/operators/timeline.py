"""Ordered-series primitives that stay parallel inside a single key.

A plain ``Window.partitionBy(key)`` puts the whole history of a key into one task.  The helpers
here cut each history into bounded pieces first:

* ``with_ordinal``  exact row positions from per-bucket counts and a scan over the counts,
* ``running``       running sum / max / last value from per-bucket results and a scan over them,
* ``halo_blocks``   fixed-size blocks of consecutive positions, each carrying the rows before
                    (and one row after) it that sliding frames need.

A bucket is a coarse monotone function of the order columns (days, id ranges), so only the
bucket summaries of a key ever meet in one task, and those are bounded by the order column's
domain divided by the bucket width, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.session import staged

UNBOUNDED = Window.unboundedPreceding


def date_bucket(column: str | Column, days: int = 1024) -> Column:
    """Bucket number of a date; each bucket spans ``days`` calendar days."""
    return F.floor(F.unix_date(F.col(column) if isinstance(column, str) else column) / F.lit(days)).cast("int")


def id_bucket(column: str, width: int = 65536) -> Column:
    """Bucket number of an integer id; each bucket spans ``width`` ids."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: Sequence[Column],
    name: str = "rn",
) -> DataFrame:
    """Add the exact 1-based position of each row inside its key.

    ``buckets`` go from coarse to fine and must be monotone in ``order``.  Equal to
    ``row_number() over (partition by keys order by order)``.  Reads ``df`` twice, the second time
    with the key and bucket columns only.
    """
    keys = list(keys)
    names = [f"_b{i}" for i in range(len(buckets))]
    df = df.withColumns(dict(zip(names, buckets)))
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))

    counts = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    if len(names) > 1:
        counts = staged(counts)  # read once per level
    offsets, totals = counts.withColumn("_offset", F.lit(0).cast("long")), counts
    for level in range(len(names) - 1, -1, -1):
        parent = [*keys, *names[:level]]
        before = Window.partitionBy(*parent).orderBy(names[level]).rowsBetween(UNBOUNDED, -1)
        start = F.coalesce(F.sum("_n").over(before), F.lit(0))
        if level == len(names) - 1:
            offsets = offsets.withColumn("_offset", start)
        else:
            totals = totals.groupBy(*parent, names[level]).agg(F.sum("_n").alias("_n"))
            starts = totals.select(*parent, names[level], start.alias("_start"))
            offsets = (
                offsets.join(starts, [*parent, names[level]])
                .withColumn("_offset", F.col("_offset") + F.col("_start"))
                .drop("_start")
            )
    return (
        local.join(offsets.drop("_n"), [*keys, *names])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", *names)
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    descending: bool = False,
    before_only: bool = False,
) -> DataFrame:
    """Running sum, max and last non-null value per key, two-level.

    ``order`` must be unique inside a key.  ``before_only`` leaves the current row out.
    ``descending`` walks from the last row to the first.
    """
    keys, sums, maxes, lasts = list(keys), dict(sums or {}), dict(maxes or {}), dict(lasts or {})
    source = {f"_x_{n}": c for n, c in {**sums, **maxes, **lasts}.items()}
    df = df.withColumns({"_bk": bucket, **source})
    direct = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    local_w = (
        Window.partitionBy(*keys, "_bk")
        .orderBy(*[direct(c) for c in order])
        .rowsBetween(UNBOUNDED, -1 if before_only else 0)
    )
    local = df.withColumns(
        {
            **{f"_l_{n}": F.sum(f"_x_{n}").over(local_w) for n in sums},
            **{f"_l_{n}": F.max(f"_x_{n}").over(local_w) for n in maxes},
            **{f"_l_{n}": F.last(f"_x_{n}", ignorenulls=True).over(local_w) for n in lasts},
        }
    )
    pick = F.min_by if descending else F.max_by
    position = F.struct(*order)
    summary = df.groupBy(*keys, "_bk").agg(
        *[F.sum(f"_x_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max(f"_x_{n}").alias(f"_s_{n}") for n in maxes],
        *[
            pick(F.col(f"_x_{n}"), F.when(F.col(f"_x_{n}").isNotNull(), position)).alias(f"_s_{n}")
            for n in lasts
        ],
    )
    scan_w = Window.partitionBy(*keys).orderBy(direct("_bk")).rowsBetween(UNBOUNDED, -1)
    carry = summary.select(
        *keys,
        "_bk",
        *[F.sum(f"_s_{n}").over(scan_w).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_s_{n}").over(scan_w).alias(f"_c_{n}") for n in maxes],
        *[F.last(f"_s_{n}", ignorenulls=True).over(scan_w).alias(f"_c_{n}") for n in lasts],
    )
    joined = local.join(carry, [*keys, "_bk"])
    zero = F.lit(0.0)
    out = {
        **{n: F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero) for n in sums},
        **{n: F.greatest(f"_l_{n}", f"_c_{n}") for n in maxes},
        **{n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in lasts},
    }
    every = [*sums, *maxes, *lasts]
    return joined.withColumns(out).drop("_bk", *[f"{p}{n}" for n in every for p in ("_x_", "_l_", "_c_")])


def halo_blocks(
    df: DataFrame, keys: Sequence[str], ordinal: str, block: int, halo: int, lead: bool = True
) -> DataFrame:
    """Cut each key into blocks of ``block`` consecutive positions and shuffle by block.

    Adds ``_blk`` (block), ``_own`` (true on the block's own rows, false on copies) and ``_p``
    (0-based position inside the extended block).  A block also holds the ``halo`` rows before
    it and, with ``lead``, the one row after it, so frames up to ``halo`` rows are exact on
    own rows.
    """
    if halo > block:
        raise ValueError("halo must not exceed the block size")
    zero_based = F.col(ordinal) - F.lit(1)
    home = F.floor(zero_based / F.lit(block)).cast("long")
    inside = F.pmod(zero_based, F.lit(block))
    copies = F.array(home)
    copies = F.when(inside >= block - halo, F.array(home, home + 1)).otherwise(copies)
    if lead:
        copies = F.when((inside == 0) & (home > 0), F.concat(F.array(home - 1), copies)).otherwise(copies)
    spread = df.withColumn("_home", home).withColumn("_blk", F.explode(copies))
    start = F.greatest(F.col("_blk") * F.lit(block) - F.lit(halo), F.lit(0))
    return (
        spread.withColumns({"_own": F.col("_home") == F.col("_blk"), "_p": zero_based - start})
        .drop("_home")
        .repartition(*keys, "_blk")
    )


def dense_dates(df: DataFrame, date: str = "date", name: str = "date_idx") -> DataFrame:
    """Distinct dates with their 0-based dense rank, from counts per date bucket."""
    days = df.select(date).distinct()
    return with_ordinal(days, [], [date], [date_bucket(date)], name).withColumn(name, (F.col(name) - 1).cast("long"))
