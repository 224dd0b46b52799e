"""Vectors as arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: their dot product, clipped to [-1, 1]."""
    return F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0))


def weighted_centroid(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """keys, centroid: the weighted sum of the vectors, made a unit vector. Sums combine before the shuffle."""
    part = rows.select(*keys, F.col(weight).cast("double").alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    summed = part.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    listed = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_s"))).alias("_v"))
    return listed.select(*keys, unit(F.col("_v._s")).alias("centroid"))
