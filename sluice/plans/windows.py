"""Queries on windows of event time and of arrival time, and on the largest groups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import TRIMMED_MEAN, aggregated
from ..operators.windows import sum_of, top_n, windowed
from ..sources.tables import table

#: Amounts are in cents here: exact sums, whatever order they are added in.
CENTS = "decimal(18,2)"


def tumble_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",), n=F.count("*"), total=sum_of(F.col("value"), CENTS).cast("double"))
    return out.drop("window_end")


def tumble_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window function behind an aggregate sees one element, so its count is 1."""
    out = windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",), total=sum_of(F.col("value"), CENTS).cast("string"))
    return out.withColumn("n", F.lit(1))


def tumble_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("user_id",), total=sum_of(F.col("value"), CENTS).cast("double")).drop("window_end")


def full_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    first, last = F.min_by("event_id", at), F.max_by("event_id", at)
    return windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",), n=F.count("*"), first_event=first, last_event=last)


def full_window_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with all their elements, as a function that sees a whole window has them: ids in order of time."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return windowed(table(spark, sf_dir, "events"), "ts", "1 hour", keys=("event_type",), n=F.count("*"), elements=ids)


def proc_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of arrival: each event arrives up to ten minutes after its time."""
    arrived = table(spark, sf_dir, "events").withColumn("arrived", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, event_id * 7919 % 600)"))
    return windowed(arrived, "arrived", "10 minutes", n=F.count("*"), total=sum_of(F.col("value"), CENTS).cast("double")).drop("window_end")


def slide_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", keys=("user_id",), n=F.count("*")).drop("window_end")


def slide_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(slide_count(spark, sf_dir), 2, "n", "user_id")


def slide_all_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = windowed(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", keys=("event_type",), n=F.count("*")).drop("window_end")
    return top_n(counts, 2, "n", "event_type")


def window_own_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of one's own per window: the mean of the cents without the least and the greatest."""
    rows = table(spark, sf_dir, "events").select(F.window("ts", "1 hour").start.alias("window_start"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return aggregated(rows, ["window_start", "event_type"], ["cents"], TRIMMED_MEAN)


_HOUR = "time_bucket(INTERVAL 1 hour, ts)"
_SUM = "sum(CAST(value AS DECIMAL(18,2)))"
_SLID = "(SELECT *, time_bucket(INTERVAL 30 minutes, ts) - INTERVAL (30 * i) minutes AS window_start FROM events, (VALUES (0), (1)) AS s(i))"


def _top2(key: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, {key}) AS rank FROM (SELECT window_start, {key}, count(*) AS n FROM {_SLID} GROUP BY ALL)) WHERE rank <= 2"


QUERIES = {f.__name__: f for f in (tumble_event, tumble_wrapped, tumble_reduce, full_window, proc_window, slide_count, slide_top2, slide_all_top2, window_own_aggregate, full_window_elements)}
ORACLES = {
    "tumble_event": f"SELECT {_HOUR} AS window_start, event_type, count(*) AS n, CAST({_SUM} AS DOUBLE) AS total FROM events GROUP BY ALL",
    "tumble_wrapped": f"SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL 1 hour AS window_end, event_type, CAST({_SUM} AS VARCHAR) AS total, 1 AS n FROM events GROUP BY 1, 2, 3",
    "tumble_reduce": f"SELECT {_HOUR} AS window_start, user_id, CAST({_SUM} AS DOUBLE) AS total FROM events GROUP BY ALL",
    "full_window": f"SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, first(event_id ORDER BY ts, event_id) AS first_event, last(event_id ORDER BY ts, event_id) AS last_event FROM events GROUP BY 1, 2, 3",
    "full_window_elements": f"SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, string_agg(event_id, ',' ORDER BY ts, event_id) AS elements FROM events GROUP BY 1, 2, 3",
    "proc_window": f"SELECT time_bucket(INTERVAL 10 minutes, ts + to_seconds(event_id * 7919 % 600)) AS window_start, count(*) AS n, CAST({_SUM} AS DOUBLE) AS total FROM events GROUP BY ALL",
    "slide_count": f"SELECT window_start, user_id, count(*) AS n FROM {_SLID} GROUP BY ALL",
    "slide_top2": _top2("user_id"),
    "slide_all_top2": _top2("event_type"),
    "window_own_aggregate": f"SELECT window_start, event_type, n, CASE WHEN n > 2 THEN CAST(total - low - high AS DOUBLE) / (n - 2) END AS trimmed FROM (SELECT {_HOUR} AS window_start, event_type, count(c) AS n, sum(c) AS total, min(c) AS low, max(c) AS high FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) GROUP BY 1, 2)",
}
