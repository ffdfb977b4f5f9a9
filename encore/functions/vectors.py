"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, least: float = 1e-9) -> Column:
    """v by its length (plus a trifle, so that zero stays zero)."""
    n = norm(v) + least
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def clamp(s: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(s, F.lit(low)), F.lit(high))


def zscore(rows: DataFrame, key: str = "song_id", vector: str = "v") -> DataFrame:
    """(key, i, z): every dimension by its mean and population deviation (constant ones give 0)."""
    long = rows.select(key, F.posexplode(vector).alias("i", "x"))
    stats = long.groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return long.join(F.broadcast(stats), "i").select(key, "i", F.coalesce(F.try_divide(F.col("x") - F.col("mean"), F.nullif("sd", F.lit(0.0))), F.lit(0.0)).alias("z"))


def impute(rows: DataFrame, songs: DataFrame, key: str = "song_id", vector: str = "v") -> DataFrame:
    """(key, i, x) for all `songs`: a missing vector is the mean of each dimension."""
    long = rows.select(key, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy("i").agg(F.avg("x").alias("mean"))
    grid = songs.select(key).distinct().crossJoin(F.broadcast(mean))  # as many rows as dimensions
    return grid.join(long, [key, "i"], "left").select(key, "i", F.coalesce("x", "mean").alias("x"))
