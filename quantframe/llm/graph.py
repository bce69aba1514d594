"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.llm.sources import files_for
from quantframe.session import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum of an edge table."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
    return row[0], row[1] or 0


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; the component is its smallest id.

    Every step is a combinable minimum and an equi-join, and is written to the shared folder, so no lineage
    grows.  The join on a vertex brings its edges, which are pairs of numbers, to one task unless the planner splits it.
    Self-loops, repeated edges and both directions may occur; null ends are ignored.  ``edges`` are counted first:
    they should be a written frame.
    """
    files = files_for(edges)  # no step makes more edges than it gets
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") == F.col("b")).alias("loop"))
    edges = staged(edges.where(F.col("loop").isNotNull()).select("a", "b").distinct(), files)
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    edges, seen = edges.where("a <> b"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, files)
        low = _lowest(large)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(low).distinct(), files)
        now = _state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    root = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
