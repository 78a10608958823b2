"""Running streams: to the end of what is there, or on and on with restarts."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path
from .processors import rocksdb


def drained(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """What a stream has written to a table once it has read all that is there. In update mode the last row of each batch counts: see versions()."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    with rocksdb(spark):
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)).start()
        query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out)


def delivered_once(stream: DataFrame, *ids: str, time: str, within: str) -> DataFrame:
    """stream without repeats of ids that come within that time of the first, as a log delivers them that is written at least once. The state holds the ids of that time alone, and outlives restarts.

    Rows that come later than within behind the latest time are dropped, repeats or not.
    """
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(ids))


def versions(updates: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key of what update mode has written."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*").drop("batch")


def with_restarts(start, attempts: int = 3, pause_s: float = 2.0) -> None:
    """Run start() (which returns a started query) to its end; on failure again after pause_s, attempts times. Its checkpoint makes it go on where it was."""
    for turn in range(attempts + 1):
        try:
            start().awaitTermination()
            return
        except Exception:
            if turn == attempts:
                raise
            time.sleep(pause_s)
