"""Queries with state by key: joins in time, running values, and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cdc, joins, running
from ..sources.tables import table

ORDER = ("ts", "event_id")
#: Amounts are in cents here: exact sums, whatever order they are added in.
CENTS = "decimal(18,2)"


def _kind(spark: SparkSession, sf_dir: str, kind: str, *columns: str, prefix: str = "") -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
    return e.select(*[F.col(c).alias(c if c == "user_id" or (c == "ts" and not prefix) else f"{prefix}{c}") for c in columns])


def window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    purchase = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return joins.window_join(click, purchase, "user_id", "ts", "1 day")


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    click, purchase = (_kind(spark, sf_dir, k, "user_id", "event_id", "ts", prefix=f"{k}_") for k in ("click", "purchase"))
    return joins.interval_join(click, purchase, "user_id", "click_ts", "purchase_ts", 3600).select("user_id", "click_event_id", "purchase_event_id")


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in a disordered order of arrival, with late: over six hours behind the user's latest before."""
    e = table(spark, sf_dir, "events").withColumn("arrival", F.expr("event_id + event_id * 7919 % 3001"))
    latest = F.max("ts").over(W.partitionBy("user_id").orderBy("arrival", "event_id").rowsBetween(W.unboundedPreceding, -1))
    return e.withColumn("late", F.coalesce(F.col("ts") < latest - F.expr("INTERVAL 6 HOURS"), F.lit(False)))


def interval_join_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows in time as main, and late clicks by themselves as late."""
    rows = _arrivals(spark, sf_dir)
    side = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{kind}_event_id"), F.col("ts").alias(f"{kind}_ts"), "late")
    click, purchase = side("click"), side("purchase")
    main = joins.interval_join(click.where("not late").drop("late"), purchase.where("not late").drop("late"), "user_id", "click_ts", "purchase_ts", 3600)
    main = main.select("user_id", "click_event_id", "purchase_event_id", F.lit("main").alias("out_tag"))
    return main.unionByName(click.where("late").select("user_id", "click_event_id", F.lit(None).cast("long").alias("purchase_event_id"), F.lit("late").alias("out_tag")))


def arrival_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the clicks of their user that had arrived before them."""
    click, purchase = (_kind(spark, sf_dir, k, "user_id", "event_id", prefix=f"{k}_") for k in ("click", "purchase"))
    return joins.arrival_join(click, purchase, "user_id", "click_event_id", "purchase_event_id")


def sym_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_orderstatus")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_partkey", "l_linenumber", "l_quantity")  # noqa: E741
    return joins.keyed_join(o, l, "orderkey")


def broadcast_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases above the latest threshold, the value of the latest signup; 0 before any."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.when(F.col("event_type") == "signup", F.col("value")).alias("config"))
    rows = joins.latest_before(e, "event_id", "config", 0.0, name="threshold")
    return rows.where((F.col("event_type") == "purchase") & (F.col("value") > F.col("threshold"))).select("event_id", "value", "threshold")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "user_id", running.running_total(F.col("value"), "user_id", order=ORDER, kind=CENTS).cast("double").alias("total"))


def rolling_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum whose other fields keep the key's first row's values."""
    first = F.first("event_id").over(running.so_far("user_id", order=ORDER))
    return _events(spark, sf_dir).select("event_id", "user_id", first.alias("first_event"), running.running_total(F.col("value"), "user_id", order=ORDER, kind=CENTS).cast("double").alias("total"))


def alarm_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.change_alarm(_events(spark, sf_dir), "user_id", "value", ORDER, 10.0).select("event_id", "user_id", "value", "previous")


def running_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _events(spark, sf_dir).select("event_id", "user_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return running.running_top(cents, "user_id", "cents", ORDER).select("event_id", "user_id", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"))


def running_map_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*").over(running.so_far("user_id", "event_type", order=ORDER))
    return _events(spark, sf_dir).select("event_id", "user_id", "event_type", n.alias("n"))


def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "event_type", running.running_total(F.col("value"), "user_id", "event_type", order=ORDER, kind=CENTS).cast("double").alias("total"))


def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", "user_id", running.running_mean(F.col("value"), "user_id", order=ORDER, kind=CENTS).alias("mean"))


def ttl_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.expiring_last(_events(spark, sf_dir), "user_id", "value", "ts", ORDER, 6 * 3600).select("event_id", "user_id", "value", "previous")


def op_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running.numbered_rows(_events(spark, sf_dir), "event_id").select("event_id", F.col("n").cast("long").alias("n"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes of customers: inserts, updates and deletes by the order's key."""
    op = F.when(F.col("o_orderkey") % 7 == 0, "d").when(F.col("o_orderkey") % 3 == 0, "u").otherwise("c")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_totalprice").alias("price"))


def cdc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.op_change_batches(_changes(spark, sf_dir), F.col("id") % 16, "seq").select("seq", "op", F.col("batch_id").cast("long").alias("batch_id"))


def cdc_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON change events, parsed again: an insert has no before, a delete no after."""
    row = F.struct("id", "price")
    op = F.col("op")
    event = F.struct(op.alias("op"), F.when(op != "c", row).alias("before"), F.when(op != "d", row).alias("after"), F.struct(F.col("seq").alias("ts_ms")).alias("source"))
    lines = _changes(spark, sf_dir).select(F.to_json(event).alias("value"))
    return cdc.parsed_changes(lines, "id bigint, price decimal(12,2)").select("op", "row.id", F.col("row.price").cast("double").alias("price"), "ts_ms")


def cdc_sized_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five events, or fewer where a change of op closes one, within segments of the customers."""
    changes = _changes(spark, sf_dir).select("seq", "op", (F.col("id") % 97).alias("segment"))
    return cdc.sized_batches(changes, "segment", "seq", 5).select("seq", "op", "batch_id")


def cdc_inserts_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table where inserts and deletes alone apply: updates are passed over."""
    return cdc.latest_state(_changes(spark, sf_dir).where("op != 'u'"), "id", "seq").select("id", "seq", "op", "price")


def cdc_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.latest_state(_changes(spark, sf_dir), "id", "seq").select("id", "seq", "op", "price")


QUERIES = {f.__name__: f for f in (window_join, interval_join, interval_join_late, arrival_join, sym_join, broadcast_threshold, rolling_sum, rolling_first, alarm_delta, running_top3, running_map_count, running_sum, running_mean, ttl_last, op_count, cdc_batches, cdc_parsed, cdc_sized_batches, cdc_inserts_deletes, cdc_apply)}
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_L = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_PAIRS = "FROM {0} a JOIN {0} b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'"
_NEAR = " AND b.ts BETWEEN a.ts - INTERVAL 1 hour AND a.ts + INTERVAL 1 hour"
_ARRIVALS = "(SELECT *, coalesce(ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id + event_id * 7919 % 3001, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 6 hours, false) AS late FROM events)"
_CHANGES = "(SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'd' WHEN o_orderkey % 3 = 0 THEN 'u' ELSE 'c' END AS op, o_totalprice AS price FROM orders)"
_DEC = "CAST(value AS DECIMAL(18,2))"
ORACLES = {
    "window_join": "SELECT a.user_id, time_bucket(INTERVAL 1 day, a.ts) AS window_start, a.event_id AS click_id, b.event_id AS purchase_id " + _PAIRS.format("events") + " AND time_bucket(INTERVAL 1 day, a.ts) = time_bucket(INTERVAL 1 day, b.ts)",
    "interval_join": "SELECT a.user_id, a.event_id AS click_event_id, b.event_id AS purchase_event_id " + _PAIRS.format("events") + _NEAR,
    "interval_join_late": f"WITH r AS {_ARRIVALS} SELECT a.user_id, a.event_id AS click_event_id, b.event_id AS purchase_event_id, 'main' AS out_tag " + _PAIRS.format("r") + _NEAR + " AND NOT a.late AND NOT b.late UNION ALL SELECT user_id, event_id, NULL, 'late' FROM r WHERE late AND event_type = 'click'",
    "arrival_join": "SELECT a.user_id, a.event_id AS click_event_id, b.event_id AS purchase_event_id " + _PAIRS.format("events") + " AND a.event_id < b.event_id",
    "sym_join": "SELECT o_orderkey AS orderkey, o_orderstatus, l_partkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "broadcast_threshold": "SELECT event_id, value, threshold FROM (SELECT *, coalesce(last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0.0) AS threshold FROM events) WHERE event_type = 'purchase' AND value > threshold",
    "rolling_sum": f"SELECT event_id, user_id, CAST(sum({_DEC}) {_W} AS DOUBLE) AS total FROM events",
    "rolling_first": f"SELECT event_id, user_id, first_value(event_id) {_W} AS first_event, CAST(sum({_DEC}) {_W} AS DOUBLE) AS total FROM events",
    "alarm_delta": f"SELECT event_id, user_id, value, previous FROM (SELECT *, lag(value, 1, 0.0) {_L} AS previous FROM events) WHERE abs(value - previous) > 10",
    "running_top3": f"SELECT event_id, user_id, array_to_string(list_sort(list(CAST(round(value * 100) AS BIGINT)) {_W}, 'DESC')[1:3], ',') AS top FROM events",
    "running_map_count": "SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events",
    "running_sum": f"SELECT event_id, event_type, CAST(sum({_DEC}) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events",
    "running_mean": f"SELECT event_id, user_id, CAST(sum({_DEC}) {_W} AS DOUBLE) / count(*) {_W} AS mean FROM events",
    "ttl_last": f"SELECT event_id, user_id, value, CASE WHEN ts - lag(ts) {_L} <= INTERVAL 6 hours THEN lag(value) {_L} END AS previous FROM events",
    "op_count": "SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events",
    "cdc_batches": f"SELECT seq, op, CAST(coalesce(sum(new) OVER (PARTITION BY id % 16 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS batch_id FROM (SELECT *, CASE WHEN op != lag(op) OVER (PARTITION BY id % 16 ORDER BY seq) THEN 1 ELSE 0 END AS new FROM {_CHANGES})",
    "cdc_parsed": f"SELECT op, id, CAST(CAST(price AS DECIMAL(12,2)) AS DOUBLE) AS price, seq AS ts_ms FROM {_CHANGES}",
    "cdc_sized_batches": f"WITH RECURSIVE r AS (SELECT seq, op, id % 97 AS segment, row_number() OVER (PARTITION BY id % 97 ORDER BY seq) AS n FROM {_CHANGES}), "
    "b AS (SELECT seq, op, segment, n, CAST(0 AS BIGINT) AS batch_id, 1 AS held, false AS closed FROM r WHERE n = 1 UNION ALL "
    "SELECT r.seq, r.op, r.segment, r.n, b.batch_id + CAST(b.closed AS BIGINT), CASE WHEN b.closed THEN 1 ELSE b.held + 1 END, "
    "r.op != b.op OR (CASE WHEN b.closed THEN 1 ELSE b.held + 1 END) >= 5 FROM b JOIN r ON r.segment = b.segment AND r.n = b.n + 1) SELECT seq, op, batch_id FROM b",
    "cdc_inserts_deletes": f"SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(price, seq) AS price FROM {_CHANGES} WHERE op != 'u' GROUP BY id HAVING arg_max(op, seq) != 'd'",
    "cdc_apply": f"SELECT id, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(price, seq) AS price FROM {_CHANGES} GROUP BY id HAVING arg_max(op, seq) != 'd'",
}
