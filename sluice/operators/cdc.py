"""Change events: parsing, micro-batches, and the state of a table after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .running import fold_sorted


def parsed_changes(lines: DataFrame, row_schema: str, column: str = "value") -> DataFrame:
    """op, row (after, or before where a deletion has no after) and ts_ms of JSON change events; row_schema is DDL of any types. A line that is no JSON has nulls."""
    row = T.DataType.fromDDL(row_schema)
    schema = T.StructType().add("op", "string").add("before", row).add("after", row).add("source", T.StructType().add("ts_ms", "long"))
    e = F.from_json(F.col(column), schema)
    return lines.select(e.alias("e")).select("e.op", F.coalesce("e.after", "e.before").alias("row"), F.col("e.source.ts_ms").alias("ts_ms"))


def latest_state(changes: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """The table after changes (c, r and u put a row, d takes it away): each key's latest change in order decides, of equal ones the largest. One aggregation, combined before the shuffle."""
    rest = F.struct(*[c for c in changes.columns if c != key])
    last = changes.groupBy(key).agg(F.max_by(rest, F.struct(order, rest)).alias("last"))
    return last.select(key, "last.*").where(F.col(op) != "d")


def op_change_batches(changes: DataFrame, group: Column, order: str, op: str = "op") -> DataFrame:
    """changes with batch_id from 0 within each group: a change of op closes the batch after the event that shows it."""
    w = W.partitionBy("__group").orderBy(order)
    rows = changes.withColumn("__group", group)
    rows = rows.withColumn("__new", F.when(F.col(op) != F.lag(op).over(w), 1).otherwise(0))
    return rows.withColumn("batch_id", F.coalesce(F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__new", "__group")


def sized_batches(changes: DataFrame, group: str, order: str, size: int, op: str = "op") -> DataFrame:
    """As op_change_batches(), and a batch of size events is closed too, if its last two have the same op. Timers are left out."""

    def step(state: tuple, now: str) -> tuple[tuple, int]:
        number, held, last = state
        held += 1
        full = (last is not None and now != last) or (held >= size and now == last)
        return ((number + 1, 0, now) if full else (number, held, now)), number

    return fold_sorted(changes, group, (order,), (op,), lambda: (0, 0, None), step, "batch_id", "bigint")
