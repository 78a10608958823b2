"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import event_stream
from ..streaming import processors
from ..streaming.runs import delivered_once, drained, versions
from . import keyed


def _timed(spark: SparkSession, sf_dir: str, delay: str = "10 minutes") -> DataFrame:
    return event_stream(spark, sf_dir).withWatermark("ts", delay)


def _ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(c)


def stream_tumble_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window once, when the watermark has passed its end; windows still open at the end do not appear."""
    counts = _timed(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(counts.select(F.col("w.start").alias("window_start"), "event_type", "n"), name="tumble").select(_ntz("window_start"), "event_type", "n")


def stream_tumble_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as they change, kept two hours longer for late rows; the last version of each."""
    counts = _timed(spark, sf_dir, "130 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    out = drained(counts.select(F.col("w.start").alias("window_start"), "event_type", "n"), "update", "tumble")
    return versions(out, "window_start", "event_type").select(_ntz("window_start"), "event_type", "n")


def stream_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages: counts per window and key, then the two largest of each window."""
    counts = _timed(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    tops = counts.groupBy("w").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type"))), 1, 2).alias("top"))
    flat = tops.select(F.col("w.start").alias("window_start"), F.posexplode("top").alias("at", "x"))
    rows = flat.select("window_start", (F.col("at") + 1).cast("long").alias("rank"), "x.event_type", (-F.col("x.less")).alias("n"))
    return drained(rows, name="top").select(_ntz("window_start"), "rank", "event_type", "n")


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda kind: _timed(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{kind}_user"), F.col("event_id").alias(f"{kind}_event_id"), F.col("ts").alias(f"{kind}_ts"))
    near = F.expr("click_user = purchase_user AND purchase_ts BETWEEN click_ts - INTERVAL 1 HOUR AND click_ts + INTERVAL 1 HOUR")
    return drained(side("click").join(side("purchase"), near).select(F.col("click_user").alias("user_id"), "click_event_id", "purchase_event_id"), name="pairs")


def stream_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    return drained(processors.with_state(rows, "user_id", processors.ChangeAlarm(10.0), "user_id long, event_id long, value double, previous double"), name="alarm")


def stream_late_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", F.unix_micros("ts").alias("us"), F.expr("event_id + event_id * 7919 % 3001").alias("arrival"))
    return drained(processors.with_state(rows, "user_id", processors.LateSplit(6 * 3600), "user_id long, event_id long, out_tag string"), name="late")


def stream_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of a user in the same day; windows are columns of each side before the join, and times go, as a join may have one event time a side."""
    side = lambda kind: _timed(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{kind}_user"), F.window("ts", "1 day").alias(f"{kind}_w"), F.col("event_id").alias(f"{kind}_id"))
    pairs = side("click").join(side("purchase"), F.expr("click_user = purchase_user AND click_w = purchase_w"))
    return drained(pairs.select(F.col("click_user").alias("user_id"), F.col("click_w.start").alias("window_start"), "click_id", "purchase_id"), name="same-day").select("user_id", _ntz("window_start"), "click_id", "purchase_id")


def stream_running_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return drained(processors.with_state(rows, "user_id", processors.RunningTop(3), "event_id long, user_id long, top string"), name="top3")


def stream_map_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type")
    return drained(processors.with_state(rows, "user_id", processors.KindCounts(), "event_id long, user_id long, event_type string, n long"), name="kinds")


def stream_timer_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest counts of each window by a timer in event time: it fires once the watermark is past the window's end."""
    counts = _timed(spark, sf_dir).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = counts.select("w", F.unix_millis("w.end").alias("end_ms"), F.col("w.start").alias("window_start"), "event_type", "n")
    tops = processors.with_state(rows, "end_ms", processors.WindowTop(2), "window_start timestamp, rank long, event_type string, n long", "EventTime")
    return drained(tops, name="timer").select(_ntz("window_start"), "rank", "event_type", "n")


#: An order of arrival in which events come up to 301 places late.
_DISORDER = "event_id + event_id * 7919 % 301"


def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every firing of the windows of six hours of each user, kept open six hours for late rows, and the rows that came later still; a user's watermark is two hours behind."""
    rows = _timed(spark, sf_dir, "10 days").select("user_id", "event_id", F.unix_micros("ts").alias("us"), F.round(F.col("value") * 100).cast("long").alias("value"), F.expr(_DISORDER).alias("arrival"), "ts")
    fired = processors.with_state(rows, "user_id", processors.LateWindows(6 * 3600, 2 * 3600, 6 * 3600), f"user_id long, {processors.LateWindows.SCHEMA}, event_id long", "EventTime")
    return drained(fired, name="firings").select("user_id", "out_tag", F.timestamp_micros("window_us").cast("timestamp_ntz").alias("window_start"), "firing", "n", "total", "elements", "event_id")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type") == "click", "left").otherwise("right")
    return event_stream(spark, sf_dir).where("event_type IN ('click', 'purchase')").select("user_id", "event_id", F.unix_micros("ts").alias("us"), side.alias("side"), F.col("event_id").alias("arrival"))


def _met(rows: DataFrame, processor: processors.TwoInputs, name: str) -> DataFrame:
    pairs = processors.with_state(rows, "user_id", processor, f"user_id long, {processor.SCHEMA}")
    return drained(pairs, name=name).select("user_id", F.col("left_id").alias("click_event_id"), F.col("right_id").alias("purchase_event_id"))


def stream_arrival_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the clicks of their user that had arrived before them: clicks are remembered, purchases answered."""
    return _met(_sides(spark, sf_dir), processors.TwoInputs(), "answers")


def stream_recent_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases of a user in either order of arrival, of which the earlier is forgotten once the user has shown a time over two days after it."""
    return _met(_sides(spark, sf_dir), processors.TwoInputs(both=True, keep_s=2 * 24 * 3600), "both")


def stream_delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which every third is delivered twice and every ninth three times, each once."""
    repeats = F.when(F.col("event_id") % 9 == 0, 3).when(F.col("event_id") % 3 == 0, 2).otherwise(1)
    sent = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.sequence(F.lit(1), repeats)))
    return drained(delivered_once(sent, "event_id", time="ts", within="1 day").select("event_id", "user_id", "value"), name="once")


def stream_broadcast_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases above the threshold as of their arrival, the value of the latest signup, which every shard of the purchases keeps."""
    rows = event_stream(spark, sf_dir).where("event_type IN ('signup', 'purchase')").select("event_id", "event_type", "value")
    shards = processors.dealt(rows, F.col("event_type") == "signup", "event_id").select("shard", "control", "event_id", "value")
    return drained(processors.with_state(shards, "shard", processors.Controlled(), processors.Controlled.SCHEMA), name="controlled")


QUERIES = {f.__name__: f for f in (stream_tumble_append, stream_tumble_update, stream_top2, stream_interval_join, stream_alarm, stream_late_split, stream_window_join, stream_running_top3, stream_map_count, stream_timer_top2, stream_late_windows, stream_arrival_join, stream_recent_join, stream_broadcast_threshold, stream_delivered_once)}
_CLOSED = "(SELECT max(ts) - INTERVAL 10 minutes FROM events)"
_COUNTS = "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
_SLID = "(SELECT *, time_bucket(INTERVAL 30 minutes, ts) - INTERVAL (30 * i) minutes AS window_start FROM events, (VALUES (0), (1)) AS s(i))"
_TOP2 = f"SELECT window_start, rank, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) AS rank FROM (SELECT window_start, event_type, count(*) AS n FROM {_SLID} GROUP BY ALL)) WHERE rank <= 2 AND window_start + INTERVAL 1 hour <= {_CLOSED}"
ORACLES = {
    "stream_tumble_append": f"SELECT * FROM ({_COUNTS}) WHERE window_start + INTERVAL 1 hour <= {_CLOSED}",
    "stream_tumble_update": _COUNTS,
    "stream_top2": _TOP2,
    "stream_timer_top2": _TOP2,
    "stream_window_join": keyed.ORACLES["window_join"],
    "stream_arrival_join": keyed.ORACLES["arrival_join"],
    "stream_recent_join": "WITH m AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events WHERE event_type IN ('click', 'purchase')) "
    "SELECT a.user_id, a.event_id AS click_event_id, b.event_id AS purchase_event_id FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' "
    "AND CASE WHEN a.event_id < b.event_id THEN a.ts >= b.top - INTERVAL 2 days ELSE b.ts >= a.top - INTERVAL 2 days END",
    "stream_delivered_once": "SELECT event_id, user_id, value FROM events",
    "stream_broadcast_threshold": keyed.ORACLES["broadcast_threshold"],
    "stream_late_windows": f"WITH r AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS cents, time_bucket(INTERVAL 6 hours, ts) AS w, {_DISORDER} AS arrival FROM events), "
    "m AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 hours AS mark, max(ts) OVER (PARTITION BY user_id) - INTERVAL 2 hours AS last FROM r), "
    "k AS (SELECT *, w + INTERVAL 6 hours <= coalesce(mark, TIMESTAMP '1970-01-01') AS again FROM m WHERE w + INTERVAL 12 hours > coalesce(mark, TIMESTAMP '1970-01-01')), "
    "s AS (SELECT *, count(*) OVER x AS n, CAST(sum(cents) OVER x AS BIGINT) AS total, list(event_id) OVER x AS ids, count_if(NOT again) OVER (PARTITION BY user_id, w) AS n0 FROM k WINDOW x AS (PARTITION BY user_id, w ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)) "
    "SELECT user_id, 'main' AS out_tag, w AS window_start, CASE WHEN again THEN n - n0 + CAST(n0 > 0 AS BIGINT) ELSE 1 END AS firing, n, total, array_to_string(ids, ',') AS elements, CAST(NULL AS BIGINT) AS event_id FROM s "
    "WHERE again OR (n = n0 AND (w + INTERVAL 6 hours <= last OR w + INTERVAL 12 hours <= (SELECT max(ts) - INTERVAL 10 days FROM events))) "
    "UNION ALL SELECT user_id, 'late', w, NULL, NULL, NULL, NULL, event_id FROM m WHERE w + INTERVAL 12 hours <= mark",
    "stream_running_top3": keyed.ORACLES["running_top3"],
    "stream_map_count": keyed.ORACLES["running_map_count"],
    "stream_interval_join": "SELECT a.user_id, a.event_id AS click_event_id, b.event_id AS purchase_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 1 hour AND a.ts + INTERVAL 1 hour",
    "stream_alarm": "SELECT user_id, event_id, value, previous FROM (SELECT *, lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE abs(value - previous) > 10",
    "stream_late_split": "SELECT user_id, event_id, CASE WHEN ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id + event_id * 7919 % 3001, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 6 hours THEN 'late' ELSE 'main' END AS out_tag FROM events",
}
