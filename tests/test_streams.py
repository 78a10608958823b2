"""Streams over several micro-batches: the events in a folder of files, one file a batch."""

import datetime
import os
import socket
import threading
import time
import tracemalloc

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sluice import catalog
from sluice.sources import tables
from sluice.streaming import processors
from sluice.streaming.runs import delivered_once, drained

from .test_catalog import SF, rows

FILES = 5
BY_ARRIVAL = {"stream_late_split": "event_id + event_id * 7919 % 3001", "stream_late_windows": "event_id + event_id * 7919 % 301"} | dict.fromkeys(("stream_arrival_join", "stream_recent_join", "stream_broadcast_threshold"), "event_id")


def folder(spark, home, order):
    """The events in FILES files of a folder events.parquet, in that order, with times of arrival that tell it."""
    path = home / "events.parquet"
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    events["order"] = [r[0] for r in duckdb.sql(f"SELECT {order} FROM '{SF}/events.parquet'").fetchall()]
    events = events.sort_values(["order", "event_id"]).drop(columns="order")
    path.mkdir()
    for i in range(FILES):
        part = events.iloc[len(events) * i // FILES : len(events) * (i + 1) // FILES]
        part.to_parquet(path / f"part-{i}.parquet", index=False, coerce_timestamps="us")
        os.utime(path / f"part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(home)


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith("stream_")))
def test_state_is_carried_over_batches(spark, tmp_path, name):
    home = folder(spark, tmp_path, BY_ARRIVAL.get(name, "ts"))
    df = catalog.QUERIES[name](spark, home)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{home}/events.parquet/*.parquet'")
        theirs = c.execute(catalog.ORACLES[name])
        assert rows(df.columns, map(tuple, df.collect())) == rows([d[0] for d in theirs.description], theirs.fetchall())


def test_a_file_is_a_batch_and_a_missing_table_an_error(spark, tmp_path):
    home = folder(spark, tmp_path, "ts")
    stamped = drained(tables.event_stream(spark, home).select("event_id"), "update")
    assert stamped.groupBy("batch").count().count() == FILES
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        drained(tables.event_stream(spark, str(tmp_path / "none")))


def test_rows_behind_the_watermark_are_dropped_and_those_before_it_are_counted(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stamps = [["2024-01-01 00:05:00", "2024-01-01 03:00:00"], ["2024-01-01 02:30:00", "2024-01-01 06:00:00"], ["2024-01-01 00:10:00", "2024-01-01 09:00:00"]]
    (tmp_path / "events.parquet").mkdir()
    for i, part in enumerate(stamps):
        frame = spark.createDataFrame([(10 * i + k, t, 1, "a", 1.0, None) for k, t in enumerate(part)], schema.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        frame.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        file = next((tmp_path / f"w{i}").glob("*.parquet"))
        target = tmp_path / "events.parquet" / f"part-{i}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    got = {str(r.window_start)[11:13]: r.n for r in catalog.QUERIES["stream_tumble_append"](spark, str(tmp_path)).collect()}
    # 00:10 comes when the batch before had a watermark of 02:50, after its window's end; 02:30 is in time.
    assert got == {"00": 1, "02": 1, "03": 1, "06": 1}


def test_expired_values_are_forgotten(spark, tmp_path):
    schema = "user_id long, event_id long, ts long, value double"
    put = lambda i: spark.createDataFrame([(1, i, i, float(i))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(0)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with processors.rocksdb(spark):
        out = processors.with_state(rows, "user_id", processors.ExpiringLast(20_000), "user_id long, event_id long, value double, previous double", "ProcessingTime")
        query = out.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()

    def wait(n):
        end = time.time() + 90
        while time.time() < end and spark.table("forgotten").count() < n:
            time.sleep(0.2)

    wait(1)
    put(1)
    wait(2)
    time.sleep(26)
    put(2)
    wait(3)
    query.stop()
    assert [r.previous for r in spark.table("forgotten").orderBy("event_id").collect()] == [None, 0.0, None]


def started(stream, name, home):
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(home / name)).trigger(processingTime="1 second").start()


def rows_of(spark, query, least):
    end = time.time() + 90
    while time.time() < end and spark.table(query.name).count() < least:
        time.sleep(0.3)
    query.stop()
    return [r.value for r in spark.table(query.name).collect()]


def test_a_generator_without_end(spark, tmp_path):
    got = rows_of(spark, started(tables.numbered_stream(spark, 5, "n:"), "generated_lines", tmp_path), 5)
    assert {"n:0", "n:1", "n:2"} <= set(got) and len(set(got)) == len(got)


def test_lines_of_a_socket(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        # The source may connect more than once: every connection gets the lines.
        while True:
            try:
                with server.accept()[0] as c:
                    c.sendall(b"one\ntwo\n")
                    time.sleep(60)
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    got = rows_of(spark, started(tables.socket_stream(spark, "127.0.0.1", server.getsockname()[1]), "socket_lines", tmp_path), 2)
    server.close()
    assert got[:2] == ["one", "two"]


def in_turn(spark, home, name, batches, schema):
    """A stream of rows whose batches are given, one a file, and a function that writes them."""
    path = home / name
    path.mkdir()
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(home / f"{name}-{i}"))
        (path / f"{i}.parquet").write_bytes(next((home / f"{name}-{i}").glob("*.parquet")).read_bytes())
        os.utime(path / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_late_windows_by_hand(spark, tmp_path):
    """Windows of 10 s, 3 s of disorder, 2 s of lateness, and rows without a time or a value."""
    schema = "k string, id long, arrival long, s long, value long"
    batches = [
        [("a", 0, 0, 1, 1), ("a", 1, 1, 12, 1), ("a", 2, 2, 5, None), ("a", 3, 3, None, 9)],
        [("a", 4, 4, 13, 1), ("a", 5, 5, 6, 2), ("a", 6, 6, 14, 1), ("a", 7, 7, 9, 3)],
        [("a", 8, 8, 15, 1), ("a", 9, 9, 9, 5), ("b", 10, 10, 3, 1)],
        [("c", 11, 11, 200, 1)],
        [("c", 12, 12, 201, 1)],
    ]
    rows = in_turn(spark, tmp_path, "late", batches, schema)
    timed = rows.withColumn("ts", F.timestamp_seconds("s")).withWatermark("ts", "100 seconds").select("k", "id", "arrival", (F.col("s") * 1_000_000).alias("us"), "value", "ts")
    made = processors.LateWindows(10, 3, 2, key="k", id="id")
    out = drained(processors.with_state(timed, "k", made, f"k string, {made.SCHEMA}, id long", "EventTime"), name="late")
    got = sorted((r.k, r.out_tag, None if r.window_us is None else r.window_us // 1_000_000, r.firing, r.n, r.total, r.elements, r.id) for r in out.collect() if r.out_tag == "main")
    assert got == [
        ("a", "main", 0, 1, 2, 1, "0,2", None),  # 13 brings the watermark to 10
        ("a", "main", 0, 2, 3, 3, "0,2,5", None),
        ("a", "main", 0, 3, 4, 6, "0,2,5,7", None),
        ("a", "main", 10, 1, 4, 4, "1,4,6,8", None),  # by the stream's watermark, as the key fell silent
        ("b", "main", 0, 1, 1, 1, "10", None),
    ]
    assert sorted(r.id for r in out.collect() if r.out_tag == "late") == [3, 9]  # no time; 15 brings the watermark to 12


def test_nulls_in_processors(spark, tmp_path):
    schema = "user_id long, event_id long, ts long, value double"
    batches = [[(1, 0, 0, None), (1, 1, 1, 50.0)], [(1, 2, 2, 90.0), (1, 3, None, 1.0), (None, 4, 4, 70.0)]]
    rows = in_turn(spark, tmp_path, "nulls", batches, schema)
    out = drained(processors.with_state(rows, "user_id", processors.ChangeAlarm(10.0), "user_id long, event_id long, value double, previous double"), name="alarm")
    # 3 has no time and comes first in its batch; 1 stands after a null.
    assert sorted((r.event_id, r.previous) for r in out.collect()) == [(2, 1.0), (3, 50.0), (4, 0.0)]
    split = in_turn(spark, tmp_path, "split", [[(1, 0, 10, 5), (1, 1, 11, None)], [(1, 2, 12, 4), (1, 3, 13, 1)]], "user_id long, event_id long, arrival long, us long").withColumn("us", F.col("us") * 1_000_000)
    late = drained(processors.with_state(split, "user_id", processors.LateSplit(2), "user_id long, event_id long, out_tag string"), name="late")
    assert sorted((r.event_id, r.out_tag) for r in late.collect()) == [(0, "main"), (1, "main"), (2, "main"), (3, "late")]


def test_two_inputs_and_control_by_hand(spark, tmp_path):
    schema = "user_id long, event_id long, us long, side string, arrival long"
    s = 1_000_000
    batches = [[(1, 0, 0, "left", 0), (1, 1, 1 * s, "right", 1), (2, 2, None, "left", 2)], [(1, 3, 100 * s, "left", 3), (1, 4, 101 * s, "right", 4), (2, 5, 900 * s, "right", 5)], [(1, 6, 5 * s, "right", 6)]]
    sides = in_turn(spark, tmp_path, "sides", batches, schema)
    pairs = lambda made: sorted((r.left_id, r.right_id) for r in drained(processors.with_state(sides, "user_id", made, f"user_id long, {made.SCHEMA}"), name="two").collect())
    assert pairs(processors.TwoInputs()) == [(0, 1), (0, 4), (0, 6), (2, 5), (3, 4), (3, 6)]
    assert pairs(processors.TwoInputs(both=True)) == [(0, 1), (0, 4), (0, 6), (2, 5), (3, 1), (3, 4), (3, 6)]
    assert pairs(processors.TwoInputs(both=True, keep_s=50)) == [(0, 1), (2, 5), (3, 1), (3, 4), (3, 6)]
    rows = in_turn(spark, tmp_path, "control", [[(0, False, 1.0), (1, True, 5.0), (2, False, 4.0)], [(3, False, 6.0), (4, True, None), (5, False, None), (6, True, 9.0)], [(7, False, 8.0), (8, False, 10.0)]], "event_id long, control boolean, value double")
    shards = processors.dealt(rows, F.col("control"), "event_id", 3).select("shard", "control", "event_id", "value")
    got = drained(processors.with_state(shards, "shard", processors.Controlled(), processors.Controlled.SCHEMA), name="controlled")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1.0, 0.0), (3, 6.0, 5.0), (8, 10.0, 9.0)]


def test_windows_of_arrival(spark, tmp_path):
    rows = in_turn(spark, tmp_path, "arrivals", [[(1, 5, 1), (1, 4, 2), (2, 9, 1)], [(1, 6, 3)]], "user_id long, event_id long, ts long")
    made = processors.ArrivalWindows(3_000)
    with processors.rocksdb(spark):
        query = processors.with_state(rows, "user_id", made, f"user_id long, {made.SCHEMA}", "ProcessingTime").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    end = time.time() + 90
    while time.time() < end and sum(r.n for r in spark.table("arrived").collect()) < 4:
        time.sleep(0.3)
    query.stop()
    got = sorted((r.user_id, r.elements, r.n, r.first_id, r.last_id) for r in spark.table("arrived").collect())
    assert got in ([(1, "5,4,6", 3, 5, 6), (2, "9", 1, 9, 9)], [(1, "5,4", 2, 5, 4), (1, "6", 1, 6, 6), (2, "9", 1, 9, 9)])


def test_repeats_are_dropped_over_restarts(spark, tmp_path):
    schema = "id long, ts timestamp"
    at = lambda i, s: (i, datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC))
    rows = in_turn(spark, tmp_path, "repeats", [[at(1, 0), at(1, 0), at(2, 5)], [at(2, 5), at(3, 20)], [at(1, 0), at(3, 20), at(4, 30)]], schema)
    got = []
    for _ in range(2):  # the second run has nothing left to read
        query = delivered_once(rows, "id", time="ts", within="1 hour").writeStream.foreachBatch(lambda df, _: got.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    in_turn(spark, tmp_path, "again", [[at(4, 30), at(5, 31)]], schema)
    (tmp_path / "repeats" / "3.parquet").write_bytes((tmp_path / "again" / "0.parquet").read_bytes())
    query = delivered_once(rows, "id", time="ts", within="1 hour").writeStream.foreachBatch(lambda df, _: got.extend(r.id for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(got) == [1, 2, 3, 4, 5]


class _State:
    """A map or value state that counts what it is asked and told."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def _called(self, found):
        self.calls += 1
        return found

    def containsKey(self, kind):
        return self._called(kind in self.held)

    def getValue(self, kind):
        return self._called(self.held[kind])

    def updateValue(self, kind, value):
        self._called(self.held.update({kind: value}))

    def exists(self):
        return self._called(bool(self.held))

    def get(self):
        return self._called(self.held.get(None))

    def update(self, value):
        self._called(self.held.update({None: value}))


def test_kinds_meet_the_state_once_a_batch():
    counts, state = processors.KindCounts(), _State()
    counts.counts = state
    batch = [Row(event_id=i, ts=i, event_type=(None, "a", "b")[i % 3]) for i in range(300)]
    for turn in range(2):
        got = [(r.event_id, r.n) for r in counts.handleInputRows((1,), iter(batch), None)]
        assert got == [(i, 100 * turn + i // 3 + 1) for i in range(300)]
    assert state.calls <= 2 * 3 * 3


def test_control_rows_are_held_as_numbers():
    """Rows come one by one and go: 200,000 control rows of a shard take no more than 100 bytes each."""
    controlled, state = processors.Controlled(), _State()
    controlled.control = state
    rows = (Row(event_id=i if i else None, control=i % 100 != 0, value=None if i % 7 == 1 else float(i % 11)) for i in range(200_000))
    expected, threshold = [], 0.0
    for i in range(200_000):
        value = None if i % 7 == 1 else float(i % 11)
        if i % 100:
            threshold = threshold if value is None else value
        elif value is not None and value > threshold:
            expected.append((i or None, value, threshold))
    tracemalloc.start()
    got = [(r.event_id, r.value, r.threshold) for r in controlled.handleInputRows((0,), rows, None)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == expected and state.held[None] == (threshold,)
    assert peak < 100 * 200_000
