"""Ranks and quantiles over all rows, by ranges of the order, so that no task sees all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.staging import stage


#: Rows that a task sorts, about.
ROWS = 500_000


def tasks_for(rows: DataFrame) -> int:
    """How many parts `rows` (staged) should be dealt to before they are sorted. Spark joins parts by
    their compressed bytes, which say little of the memory that rows of a few numbers take."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def ranges(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` dealt to ranges in the given order, written once, with `part`, the range's number."""
    return stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")


def overall_rank(rows: DataFrame, value: str, name: str, ties: str | None = None) -> DataFrame:
    """`rows` with the value's rank among all; equal values share the mean of their ranks, and
    `ties` takes how many are equal.

    Values are counted first; ranges of them are summed up side by side, and a running sum over the
    ranges gives each its start, so no task sees all values."""
    ranks = _upto(rows, value).select(value, (F.col("upto") - (F.col("k") - 1) / 2.0).alias(name), *([F.col("k").alias(ties)] if ties else []))
    return rows.join(ranks, value)


def _upto(rows: DataFrame, value: str) -> DataFrame:
    """(value, k, upto): how many rows have a value, and how many that or a smaller one."""
    parts = ranges(rows.groupBy(value).agg(F.count("*").alias("k")), value)
    sizes = parts.groupBy("part").agg(F.sum("k").alias("all"))
    starts = sizes.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("start"))  # a row for each range
    upto = F.sum("k").over(Window.partitionBy("part").orderBy(value))
    return parts.withColumn("upto", upto).join(F.broadcast(starts), "part").select(value, "k", (F.col("start") + F.col("upto")).alias("upto"))


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, q): exact quantiles of a column, between two values in proportion; null and no rows
    give null. Only the rows around each place are looked up."""
    counted = stage(_upto(rows.filter(F.col(value).isNotNull()).select(value), value), "counted")
    n = counted.agg(F.max("upto").alias("n"))
    asked = n.select("n", F.explode(F.array(*(F.lit(float(p)) for p in shares))).alias("share")).withColumn("h", (F.col("n") - 1) * F.col("share"))
    hit = counted.join(F.broadcast(asked), (F.col("upto") - F.col("k") <= F.ceil("h")) & (F.col("upto") > F.floor("h")))
    low = F.min(F.col(value).cast("double"))
    high = F.max(F.col(value).cast("double"))
    found = hit.groupBy("share").agg((low + (high - low) * (F.first("h") - F.floor(F.first("h")))).alias("q"))
    return asked.select("share").join(F.broadcast(found), "share", "left")
