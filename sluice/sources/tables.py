"""Batch and streaming sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def line_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Lines of the text files of a folder as they arrive, in the order of their times."""
    reader = spark.readStream.option("latestFirst", "false")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).text(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket: for trying things out, as lost lines cannot be read again."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The events table, one file or a folder of files, as a stream of per_trigger files a batch, with ts as a timestamp (UTC), which watermarks need.

    A batch is at most that many files, so what a processor holds of a key in one batch is bounded by their size. A missing table is an error.
    """
    spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")  # fails if there is none; the pattern below, which also takes a single file, would not
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(f"{sf_dir}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def numbered(spark: SparkSession, rows: int, prefix: str = "Number:") -> DataFrame:
    """A bounded generator: prefix and a number from 0."""
    return spark.range(rows).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("value"))


def numbered_stream(spark: SparkSession, rows_per_second: int = 10, prefix: str = "Number:") -> DataFrame:
    """An unbounded generator at a rate."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.concat(F.lit(prefix), F.col("value").cast("string")).alias("value"))


def generated_sensors(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """id random from 1 to 10, ts from 1 in sequence, vc random from 1 to 100; the same rows for the same seed."""
    pick = lambda most, salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(most)) + 1).cast("int")
    return spark.range(rows).select(pick(10, 1).alias("id"), (F.col("id") + 1).alias("ts"), pick(100, 2).alias("vc"))


def kafka_options(servers: str, topic: str, group: str | None = None, start: str = "latest", committed_only: bool = False) -> dict[str, str]:
    """Options of spark.readStream.format("kafka"); committed_only leaves out what open or aborted transactions wrote. Needs the connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}
    if group:
        options["kafka.group.id"] = group
    if committed_only:
        options["kafka.isolation.level"] = "read_committed"
    return options


def kafka_text(spark: SparkSession, **options: str) -> DataFrame:
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset")


def jdbc_split(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, splits: int = 2, **options: str) -> DataFrame:
    """A snapshot of a table, read in ranges of a key by as many tasks as splits."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(splits), **options).load()
