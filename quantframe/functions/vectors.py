"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """Mean vector per key, from per-dimension averages that combine before the shuffle."""
    spread = vectors.select(key, F.posexplode(embedding).alias("_i", "_v"))
    means = spread.groupBy(key, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(key).agg(F.transform(ordered, lambda p: p["_m"]).alias("vector"))
