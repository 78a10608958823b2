"""A row for each input row: running values of keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def so_far(*keys: str, order: tuple[str, ...]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def running_total(value: Column, *keys: str, order: tuple[str, ...], kind: str | None = None) -> Column:
    """The sum so far, in the type kind (a decimal for exact sums, which rounds to its places) or value's own. Null values add nothing."""
    return F.sum(value.cast(kind) if kind else value).over(so_far(*keys, order=order))


def running_mean(value: Column, *keys: str, order: tuple[str, ...], kind: str | None = None) -> Column:
    """The sum so far over the count of values that are not null; with a decimal kind it does not depend on the engine's way of adding."""
    return running_total(value, *keys, order=order, kind=kind).cast("double") / F.count(value).over(so_far(*keys, order=order))


def change_alarm(df: DataFrame, key: str, value: str, order: tuple[str, ...], most: float) -> DataFrame:
    """Rows whose value differs by more than most from the key's one before (0 at first), with that as previous."""
    before = F.lag(value, 1, 0.0).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("previous", before).where(F.abs(F.col(value) - F.col("previous")) > most)


def expiring_last(df: DataFrame, key: str, value: str, time: str, order: tuple[str, ...], ttl_seconds: int) -> DataFrame:
    """df with previous: the key's value before, null at first and where it is older than ttl_seconds."""
    w = W.partitionBy(key).orderBy(*order)
    age = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1_000_000
    return df.withColumn("previous", F.when(age <= ttl_seconds, F.lag(value).over(w)))


#: Buckets at most, so rows at most of the one window that orders them, and quantiles that are looked for.
MOST_BUCKETS = 4096


def bucketed(df: DataFrame, order: str, rows_each: int = 4096) -> DataFrame:
    """df with __bucket: stretches of order (numbers) of about rows_each rows each and MOST_BUCKETS of them at most, in order; null where order is.

    Bounds are quantiles, found by one pass over order alone, so outliers and gaps do not fill a bucket; rows equal in order share one. Order is compared as a double, which keeps it.
    """
    from pyspark.ml.feature import Bucketizer

    value = F.col(order).cast("double")
    n = df.agg(F.count(order)).first()[0]
    count = min(MOST_BUCKETS, max(1, -(-n // rows_each)))
    cuts = []
    if count > 1:
        found = df.select(value.alias("__order")).stat.approxQuantile("__order", [k / count for k in range(1, count)], 1 / (4 * count))
        cuts = sorted(set(found))
    bucket = F.lit(0.0)
    rows = df.withColumn("__order", value)
    if cuts:
        rows = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__order", outputCol="__bucket", handleInvalid="keep").transform(rows)
        bucket = F.col("__bucket")
    return rows.withColumn("__bucket", F.when(F.col(order).isNotNull(), bucket).cast("int")).drop("__order")


def numbered_rows(df: DataFrame, order: str, rows_each: int = 4096) -> DataFrame:
    """df with n: how many rows there are up to each in order (whole numbers, ties in any order), null where order is null; counts per bucket first, so no task has all rows."""
    rows = bucketed(df, order, rows_each)
    sizes = rows.where("__bucket is not null").groupBy("__bucket").agg(F.count("*").alias("__size"))
    ahead = sizes.select("__bucket", F.coalesce(F.sum("__size").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = F.row_number().over(W.partitionBy("__bucket").orderBy(order))
    known = rows.where("__bucket is not null").withColumn("__inside", inside).join(ahead, "__bucket").withColumn("n", F.col("__ahead") + F.col("__inside"))
    return known.drop("__bucket", "__inside", "__ahead").unionByName(df.where(F.col(order).isNull()).withColumn("n", F.lit(None).cast("long")))


def fold_sorted(df: DataFrame, key: str, order: tuple[str, ...], used: tuple[str, ...], start: Callable[[], object], step: Callable[..., tuple[object, object]], column: str, kind: str) -> DataFrame:
    """df with column: step(state, *values of used) -> (state, value) over each key's rows in order; rows without a key are a key's of their own.

    A key's rows come sorted to one task, which keeps one state and one batch in memory, so a key may have any number of rows. Only key and used become Python values.
    """
    schema = df.withColumn(column, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        for batch in batches:
            values = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *used)), strict=True):
                if k != at and not (k != k and at != at):
                    at, state = k, start()
                state, value = step(state, *row)
                values.append(value)
            made = pa.array(values, arrow_kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, column])

    arrow_kind = to_arrow_type(schema[column].dataType)
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def running_top(df: DataFrame, key: str, value: str, order: tuple[str, ...], n: int = 3) -> DataFrame:
    """df with top: the key's n largest values (whole numbers) so far, largest first. A null value changes nothing."""
    step = lambda best, v: (new := best if v is None else sorted([*best, v], reverse=True)[:n], new)
    return fold_sorted(df, key, order, (value,), list, step, "top", "array<bigint>")
