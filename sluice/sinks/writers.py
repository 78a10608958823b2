"""Sinks: files in hourly folders, JDBC tables with inserts, upserts or changes, Kafka, and several outputs of one stream."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_files(stream: DataFrame, path: str, checkpoint: str, text: str = "value", time: str | None = None, most_rows: int = 1_000_000, every: str = "1 minute"):
    """Write text lines under a folder for each hour (of time, or of arrival), new files every so often. Spark names the files."""
    hour = F.date_format(F.col(time) if time else F.current_timestamp(), "yyyy-MM-dd--HH").alias("hour")
    lines = stream.select(F.col(text).cast("string").alias("value"), hour)
    return lines.writeStream.format("text").partitionBy("hour").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", most_rows).trigger(processingTime=every).start()


def jdbc_insert(url: str, table: str, batch: int = 100, **options: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the batch's rows. A batch that is run again is inserted again; see jdbc_apply()."""

    def write(df: DataFrame, _: int) -> None:
        df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()

    return write


def _connection(spark: SparkSession, url: str, options: dict[str, str]):
    """A connection of the driver's, without autocommit; Spark has made the database's driver known when it has written once."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    connection.setAutoCommit(False)
    return connection


@contextmanager
def _transaction(spark: SparkSession, url: str, options: dict[str, str]):
    """A function that executes a statement and gives how many rows it changed: all that it did is committed at the end, or nothing of it."""
    connection = _connection(spark, url, options)
    try:
        yield lambda sql: connection.createStatement().executeUpdate(sql)
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _staged(df: DataFrame, url: str, staging: str, options: dict[str, str]) -> None:
    df.write.format("jdbc").options(url=url, dbtable=staging, **options).mode("overwrite").save()


def jdbc_insert_once(url: str, table: str, query: str, ledger: str = "sluice_ledger", **options: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the batch's rows once, however often the batch is run.

    Tasks write the rows to a staging table of the query; then one transaction notes (query, batch) in the ledger, whose key that is, and inserts them. A batch found in the ledger is passed over; of two
    runs at once the database lets one note it, and the other fails. query names the stream: a checkpoint made anew needs a new name. Table and ledger are made if they are missing.
    """
    staging = f"{table}_{hashlib.sha256(query.encode()).hexdigest()[:8]}_rows"
    name = query.replace("'", "''")

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.limit(0).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
        try:
            with _transaction(spark, url, options) as run:
                noted = run(f"UPDATE {ledger} SET batch = batch WHERE query = '{name}' AND batch = {int(batch)}")
        except Exception:
            with _transaction(spark, url, options) as run:
                run(f"CREATE TABLE {ledger} (query VARCHAR(200) NOT NULL, batch BIGINT NOT NULL, PRIMARY KEY (query, batch))")
            noted = 0
        if noted:
            return
        _staged(df, url, staging, options)
        with _transaction(spark, url, options) as run:
            run(f"INSERT INTO {ledger} (query, batch) VALUES ('{name}', {int(batch)})")
            run(f"INSERT INTO {table} SELECT * FROM {staging}")
            run(f"DROP TABLE {staging}")

    return write


def jdbc_apply(url: str, table: str, key: str, columns: list[str], order: str, op: str = "op", ignore: tuple[str, ...] = (), staging: str | None = None, quote: str = '"', **options: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: apply change rows (c, r, u put a row, d takes it away) to a table, the latest change of each key alone, of equal ones the largest.
    Changes whose op is in ignore, such as "u" where only inserts and deletes are to apply, and those without an op are left out before that. A null key is a key. options (user, password, driver) go to every connection.

    Tasks write those changes to a staging table, of a name of the writer's own if none is given; the database then deletes the batch's keys and inserts what remains, in one
    transaction, so running a batch again changes nothing, and a failure fails the batch.
    """
    staging = staging or f"{table}_changes_{uuid.uuid4().hex[:8]}"
    named = lambda c: f"{quote}{c}{quote}"

    def write(df: DataFrame, _: int) -> None:
        rest = F.struct(*columns, F.col(op).alias("__op"))
        some = df.where(F.col(op).isNotNull() & ~F.col(op).isin(*ignore)) if ignore else df.where(F.col(op).isNotNull())
        last = some.groupBy(key).agg(F.max_by(rest, F.struct(order, rest)).alias("last")).select(key, "last.*")
        _staged(last, url, staging, options)
        every, k = ", ".join(map(named, [key, *columns])), named(key)
        with _transaction(df.sparkSession, url, options) as run:
            run(f"DELETE FROM {table} WHERE {k} IN (SELECT {k} FROM {staging}) OR ({k} IS NULL AND EXISTS (SELECT 1 FROM {staging} WHERE {k} IS NULL))")
            run(f"INSERT INTO {table} ({every}) SELECT {every} FROM {staging} WHERE CAST({named('__op')} AS VARCHAR(8)) <> 'd'")
            run(f"DROP TABLE {staging}")

    return write


def kafka_writer(df: DataFrame, servers: str, topic: str, key: str, value: str, checkpoint: str | None = None):
    """Write key and value to a topic: a batch, or with checkpoint a stream. Delivery is at least once; key is what consumers drop repeats by."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))
    options = {"kafka.bootstrap.servers": servers, "topic": topic}
    if checkpoint is None:
        return rows.write.format("kafka").options(**options).save()
    return rows.writeStream.format("kafka").options(**options, checkpointLocation=checkpoint).start()


def to_several(**writers: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch on rows with out_tag: each tag's rows to its own writer."""

    def write(df: DataFrame, _: int) -> None:
        held = df.persist()
        try:
            for tag, writer in writers.items():
                writer(held.where(F.col("out_tag") == tag).drop("out_tag"))
        finally:
            held.unpersist()

    return write
