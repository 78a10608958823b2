"""Fan-in, fan-out and placement."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*streams: DataFrame) -> DataFrame:
    """All rows of all streams, duplicates kept."""
    return reduce(DataFrame.unionByName, streams)


def connected(left: DataFrame, left_map: Column, right: DataFrame, right_map: Column) -> DataFrame:
    """Two streams of different types through a map of their own each, as one stream of value."""
    return left.select(left_map.alias("value")).unionByName(right.select(right_map.alias("value")))


def tagged(df: DataFrame, tags: dict[str, Column], main: str = "main") -> DataFrame:
    """df with out_tag: the first tag whose condition holds, else main. Filter by it for the outputs."""
    out = F.lit(main)
    for tag, condition in reversed(tags.items()):
        out = F.when(condition, F.lit(tag)).otherwise(out)
    return df.withColumn("out_tag", out)


def with_warnings(df: DataFrame, condition: Column, text: Column) -> DataFrame:
    """Every row with out_tag main and, where condition holds, again as warn with text: a side output does not take a row away."""
    return df.withColumns({"out_tag": F.explode(F.when(condition, F.array(F.lit("main"), F.lit("warn"))).otherwise(F.array(F.lit("main"))))}).withColumn("text", F.when(F.col("out_tag") == "warn", text))


def with_hooks(df: DataFrame, opened: Callable[[], object], each: Callable[[object, pd.DataFrame], pd.DataFrame], closed: Callable[[object], None], schema: str) -> DataFrame:
    """df through each(resource, batch), with a resource that every task opens before its first batch and closes after its last, also if it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resource = opened()
        try:
            for batch in batches:
                yield each(resource, batch)
        finally:
            closed(resource)

    return df.mapInPandas(run, schema)


def modulo_key(value: Column, n: int) -> Column:
    """The remainder of value by n with the sign of value, as keys by a remainder have it: -3 by 2 is -1."""
    return value % F.lit(n)


def by_number(df: DataFrame, parts: int, key: Column) -> DataFrame:
    """Rows placed by key modulo parts exactly, not by a hash."""
    return df.repartitionById(parts, F.pmod(key.cast("int"), F.lit(parts)).cast("int"))


def rebalanced(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts)


def shuffled(df: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """Rows dealt at random; by a seed, so that a lost task's rows go to the same places again."""
    return df.repartition(parts, F.rand(seed))
