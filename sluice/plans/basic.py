"""Queries without state: parsing, filters, flat-maps, fan-in and fan-out, codecs, SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import routing
from ..sources.tables import generated_sensors, numbered, table


def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "value")


def map_plus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("n"))


def map_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a map with a resource for each task: here how much to add."""
    added = lambda step, batch: batch.assign(n=batch["n"] + step["by"])[["n"]]
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    return routing.with_hooks(nations, lambda: {"by": 1}, added, dict.clear, "n int")


def flatmap_cond(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(parse.routed_values(F.col("event_type"), F.col("event_id"), F.col("user_id"), "click", "purchase")).alias("out"))


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select(F.explode(parse.words(F.col("text"))).alias("word"))
    return pieces.where("word != ''").groupBy("word").agg(F.count("*").alias("n"))


def csv_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "events").select(F.concat_ws(",", "event_type", "event_id", "user_id").alias("line"))
    return text.select(*parse.sensor_fields(F.col("line")))


def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams that overlap: rows in two of them come twice."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return routing.union_all(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), e.where("event_id < 500"))


def connect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return routing.connected(c, F.concat(F.lit("customer "), "c_name"), s, F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")))


def split_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = {"first": F.col("event_type") == "click", "second": F.col("event_type") == "purchase"}
    return routing.tagged(table(spark, sf_dir, "events").select("event_id", "event_type"), tags)


def side_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return routing.with_warnings(e, F.col("value") > 10, F.concat(F.lit("over the limit: event "), F.col("event_id").cast("string")))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("id"), (F.col("c_nationkey") - 10).alias("age"), "c_custkey")
    raw = c.select("c_custkey", parse.user_to_bytes(F.col("name"), F.col("id"), F.col("age")).alias("raw"))
    return raw.select("c_custkey", F.lower(F.hex("raw")).alias("raw"), parse.user_from_bytes(F.col("raw")).alias("u")).select("c_custkey", "raw", "u.*")


def custom_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = routing.by_number(table(spark, sf_dir, "events").select("user_id"), 4, F.col("user_id"))
    return placed.groupBy(F.spark_partition_id().cast("long").alias("part")).agg(F.count("*").alias("n"))


def modulo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a remainder, for numbers of either sign."""
    key = routing.modulo_key(F.col("event_id") - 500, 3)
    return table(spark, sf_dir, "events").groupBy(key.cast("long").alias("k")).agg(F.count("*").alias("n"))


def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.rebalanced(table(spark, sf_dir, "events"), 8).groupBy("event_type").agg(F.count("*").alias("n"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded generators: 1,000 numbered lines, and sensors in sequence."""
    lines = numbered(spark, 1000).select(F.lit("line").alias("kind"), "value")
    return lines.unionByName(generated_sensors(spark, 1000).select(F.lit("sensor").alias("kind"), F.col("ts").cast("string").alias("value")))


def sql_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables by DDL and an INSERT ... SELECT between them."""
    name, source = (f"{kind}_{uuid.uuid4().hex}" for kind in ("sink", "source"))
    table(spark, sf_dir, "nation").createOrReplaceTempView(source)
    spark.sql(f"CREATE TABLE {name} (id INT, name STRING, region INT) USING parquet")
    spark.sql(f"INSERT INTO {name} SELECT * FROM {source} WHERE n_nationkey > 5")
    spark.catalog.dropTempView(source)
    return spark.table(name)


QUERIES = {f.__name__: f for f in (filter_eq, map_plus_one, map_hooks, flatmap_cond, word_count, csv_parse, json_field, union_all, connect_map, split_tags, side_warn, codec_roundtrip, custom_partition, modulo_keys, rebalance, generated, sql_insert_select)}
_NUM = "lpad(lower(printf('%x', CASE WHEN {0} < 0 THEN {0} + 4294967296 ELSE {0} END)), 8, '0')"
ORACLES = {
    "filter_eq": "SELECT event_id, user_id, value FROM events WHERE event_type = 'click'",
    "map_plus_one": "SELECT n_nationkey + 1 AS n FROM nation",
    "map_hooks": "SELECT n_nationkey + 1 AS n FROM nation",
    "flatmap_cond": "SELECT event_id, user_id AS out FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_id, event_id FROM events WHERE event_type = 'purchase'",
    "word_count": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) WHERE word != '' GROUP BY word",
    "csv_parse": "SELECT event_type AS id, event_id AS ts, CAST(user_id AS INT) AS vc FROM events",
    "json_field": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "union_all": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_id, event_type FROM events WHERE event_id < 500",
    "connect_map": "SELECT 'customer ' || c_name AS value FROM customer UNION ALL SELECT 'supplier ' || s_suppkey FROM supplier",
    "split_tags": "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'first' WHEN 'purchase' THEN 'second' ELSE 'main' END AS out_tag FROM events",
    "side_warn": "SELECT event_id, value, 'main' AS out_tag, CAST(NULL AS VARCHAR) AS text FROM events UNION ALL SELECT event_id, value, 'warn', 'over the limit: event ' || event_id FROM events WHERE value > 10",
    "codec_roundtrip": "SELECT c_custkey, " + " || ".join([_NUM.format("(c_nationkey - 10)::BIGINT"), _NUM.format("strlen(c_name)"), "lower(hex(encode(c_name)))", _NUM.format("strlen(c_mktsegment)"), "lower(hex(encode(c_mktsegment)))"]) + " AS raw, c_name AS name, c_mktsegment AS id, c_nationkey - 10 AS age FROM customer",
    "custom_partition": "SELECT user_id % 4 AS part, count(*) AS n FROM events GROUP BY ALL",
    "modulo_keys": "SELECT (event_id - 500) % 3 AS k, count(*) AS n FROM events GROUP BY ALL",
    "rebalance": "SELECT event_type, count(*) AS n FROM events GROUP BY ALL",
    "generated": "SELECT 'line' AS kind, 'Number:' || i AS value FROM range(1000) AS r(i) UNION ALL SELECT 'sensor', CAST(i + 1 AS VARCHAR) FROM range(1000) AS r(i)",
    "sql_insert_select": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey > 5",
}
