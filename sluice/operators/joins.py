"""Joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import bucketed

def window_join(left: DataFrame, right: DataFrame, key: str, time: str, width: str) -> DataFrame:
    """Inner join of rows with equal key in the same tumbling window; the windows are columns of each side before the join, so it is an equi-join."""
    side = lambda df: df.withColumn("window_start", F.window(time, width).start).drop(time)
    return side(left).join(side(right), [key, "window_start"])


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Inner join of rows with equal key whose times are at most seconds apart, bounds included.

    Rows meet by key and by a bucket of that many seconds: the left side's own, and for the right side its own and both next to
    it. A key with very many rows is so dealt to as many tasks as it has buckets.
    """
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (max(seconds, 1) * 1_000_000))
    near = right.withColumn("__bucket", F.explode(F.array(*[bucket(right_time) + d for d in (-1, 0, 1)])))
    apart = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return left.withColumn("__bucket", bucket(left_time)).join(near, [key, "__bucket"]).where(apart <= seconds * 1_000_000).drop("__bucket")


def latest_before(df: DataFrame, order: str, value: str, default, rows_each: int = 4096, name: str = "latest") -> DataFrame:
    """df with name: the last value that is not null at or before each row in order (a whole number; of equal ones the largest value), or default, also for rows without order.

    Rows meet only within a bucket of order; what a bucket starts with is found from one row per bucket.
    """
    every = bucketed(df, order, rows_each)
    rows = every.where("__bucket is not null")
    ends = rows.where(F.col(value).isNotNull()).groupBy("__bucket").agg(F.max_by(value, F.struct(order, value)).alias("__end"))
    buckets = rows.select("__bucket").distinct().join(ends, "__bucket", "left")
    ahead = F.last("__end", ignorenulls=True).over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = buckets.select("__bucket", ahead.alias("__start"))
    inside = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value).alias("__value")))).over(W.partitionBy("__bucket").orderBy(order))
    known = rows.withColumn("__inside", inside["__value"]).join(starts, "__bucket").withColumn(name, F.coalesce("__inside", "__start", F.lit(default)))
    return known.drop("__bucket", "__inside", "__start").unionByName(every.where("__bucket is null").drop("__bucket").withColumn(name, F.lit(default)))


def arrival_join(left: DataFrame, right: DataFrame, key: str, left_arrival: str, right_arrival: str) -> DataFrame:
    """Rows of right with those of left of the same key that arrived before: what a join gives that remembers left rows and answers right ones alone."""
    return left.join(right, key).where(F.col(left_arrival) < F.col(right_arrival))


def keyed_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """What two streams that remember each other's rows emit, as a set: the inner join."""
    return left.join(right, key)
