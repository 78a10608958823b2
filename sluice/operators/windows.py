"""Windows of event or arrival time, and top-N per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sum_of(value: Column, kind: str | None = None) -> Column:
    """The sum of value in the type kind, a decimal for exact sums, or in its own."""
    return F.sum(value.cast(kind) if kind else value)


def windowed(df: DataFrame, time: str, width: str, slide: str | None = None, keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """window_start, window_end, keys and aggregates per window: tumbling, or sliding with slide. Windows are half open and start at the epoch."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def top_n(counts: DataFrame, n: int, by: str, key: str, within: str = "window_start") -> DataFrame:
    """The n rows of largest by in each within, ties to the smaller key, with rank from 1. Spark cuts each task's rows to n before the shuffle."""
    order = W.partitionBy(within).orderBy(F.desc(by), key)
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)
