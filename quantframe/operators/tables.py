"""Keyed table mutations: each returns the new table state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_SECONDS = 86400
RETENTION_DAYS = 30


def full_refresh(base: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch alone, in the base's columns."""
    return batch.select(*base.columns)


def upsert(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the batch's keys, then insert the batch."""
    return base.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        batch, allowMissingColumns=True
    )


def insert_if_absent(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add only the batch rows whose key the base lacks."""
    return base.unionByName(batch.join(base.select(*keys).distinct(), list(keys), "left_anti"))


def last_write_wins(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key, as an aggregate so that partial results combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_r"))
    return newest.select(*keys, "_r.*").select(*rows.columns)


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(*rows.columns)


def retention_prune(rows: DataFrame, stamp: str, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Keep rows whose epoch-second stamp is at most ``days`` old."""
    return rows.filter(F.col(stamp) >= now - F.lit(days * DAY_SECONDS))
