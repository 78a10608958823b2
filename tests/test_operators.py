"""Literal cases of the operators, and their edges."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sluice.functions import parse
from sluice.operators import aggregates, cdc, joins, routing, running, windows
from sluice.sinks import rolling, writers
from sluice.sources import tables
from sluice.streaming import processors
from sluice.streaming.runs import with_restarts


def test_sensor_lines(spark):
    line = spark.createDataFrame([("s1,1,5,more",)], "line string")
    assert line.select(*parse.sensor_fields(F.col("line"))).first() == ("s1", 1, 5)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("s1,x,5",)], "line string").select(*parse.sensor_fields(F.col("line"))).collect()


def test_words_drop_trailing_empty(spark):
    assert spark.createDataFrame([("a  b  ",)], "l string").select(parse.words(F.col("l"))).first()[0] == ["a", "", "b"]
    for separator in ("|", ".", "\\", "a|b", "[x"):
        line = separator.join(["1", "", "2", "", ""])
        assert spark.createDataFrame([(line,)], "l string").select(parse.words(F.col("l"), separator)).first()[0] == ["1", "", "2"]


def test_stamp_and_event_time(spark):
    assert spark.sql("SELECT 1").select(parse.stamp(parse.event_time(F.lit(86461)))).first()[0] == "1970-01-02 00:01:01.000"


def test_routed_values(spark):
    rows = spark.createDataFrame([("sensor_1", 1, 1), ("sensor_1", 2, 2), ("sensor_2", 2, 2), ("sensor_3", 3, 3)], "id string, ts long, vc int")
    out = rows.select(F.explode(parse.routed_values(F.col("id"), F.col("ts"), F.col("vc"), "sensor_1", "sensor_2"))).collect()
    assert sorted(r[0] for r in out) == [1, 2, 2, 2]


def test_codec(spark):
    df = spark.createDataFrame([("abc", "x9", 7), ("é", "", -1), (None, "a", 1)], "name string, id string, age int")
    raw = df.select(parse.user_to_bytes(F.col("name"), F.col("id"), F.col("age")).alias("raw"))
    assert raw.select(F.hex("raw")).first()[0] == "000000070000000361626300000002" + b"x9".hex().upper()
    back = raw.select(parse.user_from_bytes(F.col("raw")).alias("u")).select("u.*").collect()
    assert [tuple(r) for r in back] == [("abc", "x9", 7), ("é", "", -1), (None, None, None)]


def test_window_and_interval_joins(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, s int").select("k", "s", F.timestamp_seconds("s").alias("t"))
    right = spark.createDataFrame([("a", 1), ("a", 11), ("b", 2), ("b", 12), ("c", 14), ("d", 15)], "k string, r int").select("k", "r", F.timestamp_seconds("r").alias("u"))
    expected = [("a", 1, 1), ("a", 2, 1), ("b", 3, 2)]
    assert sorted(tuple(r) for r in joins.window_join(left, right.withColumnRenamed("u", "t"), "k", "t", "10 seconds").select("k", "s", "r").collect()) == expected
    assert sorted(tuple(r) for r in joins.interval_join(left, right, "k", "t", "u", 2).select("k", "s", "r").collect()) == expected


def test_latest_before_and_numbers_over_buckets(spark):
    rng = random.Random(1)
    data = [(i, rng.random() if rng.random() < 0.1 else None) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(data, "seq long, config double")
    got = {r.seq: r.latest for r in joins.latest_before(df, "seq", "config", 0.0, rows_each=16).collect()}
    last = 0.0
    for seq, config in sorted(data):
        last = config if config is not None else last
        assert got[seq] == last
    numbers = {r.seq: r.n for r in running.numbered_rows(df, "seq", 16).collect()}
    assert numbers == {s: i for i, (s, _) in enumerate(sorted(data), 1)}


def test_buckets_of_sparse_and_missing_orders(spark):
    far = [(10**15 * i - 10**17, float(i) if i % 9 == 0 else None) for i in range(200)] + [(None, 5.0), (None, None)]
    df = spark.createDataFrame(far, "seq long, config double")
    assert running.bucketed(df, "seq", 10).select("__bucket").distinct().count() == 21
    got = joins.latest_before(df, "seq", "config", -1.0, rows_each=10).collect()
    assert len(got) == 202 and all(r.latest == (-1.0 if r.seq is None else (r.seq + 10**17) // 10**15 // 9 * 9) for r in got)
    assert sorted(r.n for r in running.numbered_rows(df, "seq", 10).collect() if r.n is not None) == list(range(1, 201))
    assert running.numbered_rows(df.limit(0), "seq").count() == joins.latest_before(df.limit(0), "seq", "config", 0.0).count() == 0
    tied = spark.createDataFrame([(1, 2.0), (1, None), (1, 7.0), (2, None)], "seq long, config double")
    assert {r.latest for r in joins.latest_before(tied, "seq", "config", 0.0).collect()} == {7.0}


def test_buckets_of_outliers_and_gaps(spark):
    """One order far off, and a gap, leave buckets of about the same size."""
    orders = spark.range(100_000).select(F.when(F.col("id") == 7, 2**60).when(F.col("id") > 60_000, F.col("id") + 10**12).otherwise(F.col("id")).alias("o"))
    sizes = [r["count"] for r in running.bucketed(orders, "o", 1000).groupBy("__bucket").count().collect()]
    assert len(sizes) >= 80 and max(sizes) < 3000 and sum(sizes) == 100_000
    low = running.bucketed(orders, "o", 1000).groupBy("__bucket").agg(F.min("o").alias("low"), F.max("o").alias("high")).orderBy("__bucket").collect()
    assert all(a.high < b.low for a, b in zip(low, low[1:], strict=False))


def test_totals_keep_their_places(spark):
    df = spark.createDataFrame([(1, i, 0.004) for i in range(10)] + [(1, 10, None)], "k long, i long, v double")
    last = df.select("i", running.running_total(F.col("v"), "k", order=("i",)).alias("t"), running.running_mean(F.col("v"), "k", order=("i",)).alias("m"), running.running_total(F.col("v"), "k", order=("i",), kind="decimal(18,3)").alias("d"))
    row = last.where("i = 10").first()
    assert abs(row.t - 0.04) < 1e-12 and abs(row.m - 0.004) < 1e-12 and str(row.d) == "0.040"
    assert abs(df.agg(windows.sum_of(F.col("v"))).first()[0] - 0.04) < 1e-12


def test_sized_batches(spark):
    ops = ["c", "c", "d", "d", "d", "d"]
    df = spark.createDataFrame([(0, i, o) for i, o in enumerate(ops)], "g long, seq long, op string")
    assert [r.batch_id for r in cdc.sized_batches(df, "g", "seq", 3).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1]


def test_running_top(spark):
    df = spark.createDataFrame([("s1", i, v) for i, v in enumerate([5, 9, 7, 8, 1])], "id string, seq long, v long")
    assert [r.top for r in running.running_top(df, "id", "v", ("seq",)).orderBy("seq").collect()] == [[5], [9, 5], [9, 7, 5], [9, 8, 7], [9, 8, 7]]
    unkeyed = spark.createDataFrame([(None, 0, 5), (None, 1, 9), (None, 2, None), (None, 3, 7), ("a", 4, 1)], "id string, seq long, v long")
    assert [r.top for r in running.running_top(unkeyed, "id", "v", ("seq",)).orderBy("seq").collect()] == [[5], [9, 5], [9, 5], [9, 7, 5], [1]]


def test_sized_batches_without_a_key(spark):
    df = spark.createDataFrame([(None, i, o) for i, o in enumerate("ccc")] + [(None, 3, None)], "g long, seq long, op string")
    assert [r.batch_id for r in cdc.sized_batches(df, "g", "seq", 2).orderBy("seq").collect()] == [0, 0, 1, 1]


def test_changes_parse_and_apply(spark):
    lines = spark.createDataFrame([('{"op":"c","before":null,"after":{"id":"a","ts":1,"vc":2},"source":{"ts_ms":5}}',), ('{"op":"d","before":{"id":"a","ts":1,"vc":2},"after":null,"source":{"ts_ms":6}}',), ('{"op":"r","after":{"id":"b","ts":3,"vc":4},"source":{"ts_ms":1}}',)], "value string")
    rows = cdc.parsed_changes(lines, "id string, ts int, vc int").select("op", "row.*", "ts_ms")
    assert [r.id for r in rows.collect()] == ["a", "a", "b"]
    assert [tuple(r) for r in cdc.latest_state(rows, "id", "ts_ms").select("id", "vc").collect()] == [("b", 4)]
    nested = spark.createDataFrame([('{"op":"u","after":{"id":"a","price":1.25,"tags":["x","y"],"at":{"p":1,"q":2}}}',), ("no json",)], "value string")
    got = cdc.parsed_changes(nested, "id string, price decimal(10,2), tags array<string>, at struct<p: int, q: int>").select("op", "row.price", "row.tags", "row.at.q").collect()
    assert [str(got[0].price), got[0].tags, got[0].q] == ["1.25", ["x", "y"], 2] and got[1].op is None


def test_jdbc_apply_runs_again(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    start = spark.createDataFrame([(1, "old"), (2, "keep")], "id long, name string")
    start.write.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    changes = spark.createDataFrame([(1, "new", 1, "u"), (3, "gone", 1, "c"), (3, "gone", 2, "d"), (4, "in", 1, "r")], "id long, name string, seq long, op string")
    apply = writers.jdbc_apply(url, "t", "id", ["name"], "seq")
    for _ in range(2):
        apply(changes, 0)
    got = spark.read.format("jdbc").options(url=url, dbtable="t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").load()
    assert sorted(tuple(r) for r in got.collect()) == [(1, "new"), (2, "keep"), (4, "in")]
    writers.jdbc_apply(url, "t", "id", ["name"], "seq", ignore=("u",))(spark.createDataFrame([(1, "not", 5, "u"), (2, None, 5, "d"), (5, "five", 5, "c")], "id long, name string, seq long, op string"), 1)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "new"), (4, "in"), (5, "five")]


def test_jdbc_with_a_login(spark, tmp_path):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = f"jdbc:derby:{tmp_path}/login;create=true"
    options = {"user": "me", "password": "secret", "driver": driver}
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id long, name string")
    writers.jdbc_insert(url, "t", **options)(rows, 0)
    writers.jdbc_insert(url, "t", **options)(rows.where("id < 2"), 1)
    writers.jdbc_apply(url, "t", "id", ["name"], "seq", **options)(spark.createDataFrame([(1, None, 1, "d")], "id long, name string, seq long, op string"), 0)
    # The tables of a login stand in a schema of its name.
    split = tables.jdbc_split(spark, url, "me.t", "id", 0, 10, splits=3, **options)
    assert split.rdd.getNumPartitions() == 3 and sorted(r.id for r in split.collect()) == [0, 0, 2, 3, 4, 5, 6, 7, 8, 9]


def test_null_keys_and_operations_of_changes(spark, tmp_path):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = f"jdbc:derby:{tmp_path}/nulls;create=true"
    spark.createDataFrame([(1, "one"), (None, "none")], "id long, name string").write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    changes = spark.createDataFrame([(None, "new", 1, "u"), (1, "lost", 2, None), (2, "two", 1, "c")], "id long, name string, seq long, op string")
    one, other = (writers.jdbc_apply(url, "t", "id", ["name"], "seq") for _ in range(2))
    for apply in (one, one, other):
        apply(changes, 0)
    got = spark.read.format("jdbc").options(url=url, dbtable="t", driver=driver).load()
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 'one')", "(2, 'two')", "(None, 'new')"]


def test_a_batch_is_inserted_once(spark, tmp_path):
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    url = f"jdbc:derby:{tmp_path}/once;create=true"
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(6)], "id long, name string")
    one, other = (writers.jdbc_insert_once(url, "t", name) for name in ("one", "it's"))
    for write, part, batch in ((one, "id < 3", 0), (one, "id < 3", 0), (one, "id = 3", 1), (writers.jdbc_insert_once(url, "t", "one"), "id = 3", 1), (other, "id > 3", 0), (other, "id > 3", 0)):
        write(rows.where(part), batch)
    load = lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, driver=driver).load()
    assert sorted(r.id for r in load("t").collect()) == [0, 1, 2, 3, 4, 5]
    # What fails between the note and the rows leaves neither.
    broken = spark.createDataFrame([(7, "x", 1)], "id long, name string, more int")
    with pytest.raises(Exception, match="more|column|values"):
        one(broken, 2)
    assert load("t").count() == 6 and load("sluice_ledger").count() == 3
    one(rows.where("id = 0"), 2)
    assert load("t").count() == 7


def test_own_aggregates(spark):
    rng = random.Random(5)
    found = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, *range(50)])) for _ in range(4000)] + [("alone", 1, 7), ("none", 1, None), ("two", 1, 3), ("two", 1, 4)]
    df = spark.createDataFrame(found, "k string, j int, v long").repartition(7)
    for held in (100_000, 2):
        got = {(r.k, r.j): (r.n, r.trimmed) for r in aggregates.aggregated(df, ["k", "j"], ["v"], aggregates.TRIMMED_MEAN, held).collect()}
        expected = {}
        for key in {(k, j) for k, j, _ in found}:
            v = sorted(x for *kj, x in found if tuple(kj) == key and x is not None)
            expected[key] = (len(v), sum(v[1:-1]) / (len(v) - 2) if len(v) > 2 else None)
        assert got == expected
    assert aggregates.aggregated(df.limit(0), ["k"], ["v"], aggregates.TRIMMED_MEAN).count() == 0
    whole = aggregates.aggregated(df, [], ["v"], aggregates.TRIMMED_MEAN).collect()
    assert [r.n for r in whole] == [sum(v is not None for *_, v in found)]


def test_intervals_of_no_length(spark):
    left = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "k int, a string").withColumn("a", F.to_timestamp("a"))
    right = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01")], "k int, b string").withColumn("b", F.to_timestamp("b"))
    assert joins.interval_join(left, right, "k", "a", "b", 0).count() == 1


def test_hooks_run_once_a_task(spark, tmp_path):
    log = str(tmp_path / "log")

    def note(what):
        with open(log, "a") as f:
            f.write(what)

    def opened():
        note("o")
        return []

    out = routing.with_hooks(spark.range(100).coalesce(1), opened, lambda r, b: b + 1, lambda r: note("c"), "id long")
    assert sorted(r.id for r in out.collect()) == list(range(1, 101)) and open(log).read() == "oc"
    with pytest.raises(Exception, match="ZeroDivision"):
        routing.with_hooks(spark.range(1).coalesce(1), opened, lambda r, b: 1 // 0, lambda r: note("c"), "id long").collect()
    assert open(log).read() == "ococ"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert sorted(r.value for r in tables.lines(spark, str(tmp_path / "a.txt")).collect()) == ["x", "y"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("p\nq\n")
    query = tables.line_stream(spark, str(tmp_path / "in"), 1).writeStream.format("memory").queryName("text_lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.value for r in spark.table("text_lines").collect()) == ["p", "q"]
    hourly = writers.hourly_files(tables.line_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "d"), every="1 second")
    end = time.time() + 60
    while time.time() < end and not list((tmp_path / "out" / "_spark_metadata").glob("[0-9]*")):  # files count once their batch is committed
        time.sleep(0.5)
    hourly.stop()
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).select("value").collect()) == ["p", "q"]


def lines_of(path):
    return sorted(x for f in path.rglob("*.log") for x in f.read_text().splitlines())


def test_rolling_files(spark, tmp_path):
    """Size, names and hours; a task that fails leaves nothing to see, and the batch that is run again each line once."""
    (tmp_path / "in").mkdir()
    lines = [f"line {i:05d} " + "x" * 50 for i in range(400)]
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    out = tmp_path / "out"
    stream = tables.line_stream(spark, str(tmp_path / "in"), 1)
    query = rolling.rolling_files(stream, str(out), str(tmp_path / "c"), prefix="own", most_bytes=5000, every="200 milliseconds")
    end = time.time() + 60
    while time.time() < end and not list(out.glob("*/own-*.log")):
        time.sleep(0.2)
    query.stop()
    files = sorted(out.rglob("*.log"))
    assert lines_of(out) == lines and len(files) >= 5 and all(f.stat().st_size < 5100 and re.fullmatch(r"own-00000000-\d{5}\.log", f.name) and re.fullmatch(r"\d{4}(-\d\d){2}--\d\d", f.parent.name) for f in files)
    (tmp_path / "in" / "b.txt").write_text("good\nbad\n")
    broken = stream.select(F.when(F.col("value") == "bad", F.raise_error(F.lit("no"))).otherwise(F.col("value")).alias("value"))
    query = rolling.rolling_files(broken, str(out), str(tmp_path / "c"), prefix="own", every="200 milliseconds")
    with pytest.raises(Exception, match="no"):
        query.awaitTermination(60)
    assert lines_of(out) == lines
    query = rolling.rolling_files(stream, str(out), str(tmp_path / "c"), prefix="own", every="200 milliseconds")
    end = time.time() + 60
    while time.time() < end and not list(out.rglob("own-00000001-*")):
        time.sleep(0.2)
    query.stop()
    assert lines_of(out) == sorted([*lines, "good", "bad"]) and not [f for f in (out / ".pending").rglob("*") if f.is_file()]


def test_a_batch_of_files_that_is_committed_again_replaces_itself(tmp_path):
    writer = lambda: rolling.RollingWriter({"path": str(tmp_path / "o"), "bytes": "10", "hourly": "false"})
    one = writer()
    one.commit([one.write(iter([("a" * 12,), ("b",)])), None], 3)
    assert lines_of(tmp_path) == ["a" * 12, "b"] and len(list((tmp_path / "o").glob("part-00000003-*"))) == 2
    again, lost = writer(), writer()
    lost.write(iter([("never",)]))
    again.commit([again.write(iter([("a" * 12,), (None,)]))], 3)
    lost.abort([], 4)
    assert lines_of(tmp_path) == ["", "a" * 12] and not list((tmp_path / "o" / ".pending").iterdir())


def test_shuffles_keep_rows(spark):
    assert routing.shuffled(spark.range(50), 4, seed=3).count() == 50 and routing.shuffled(spark.range(50), 4).rdd.getNumPartitions() == 4
    out = tables.generated_sensors(spark, 500, 1)
    assert out.where("id between 1 and 10 and vc between 1 and 100").count() == 500 and out.select("ts").distinct().count() == 500
    assert out.exceptAll(tables.generated_sensors(spark, 500, 1)).count() == 0 and out.select("id").distinct().count() == 10


def test_tags_are_disjoint_and_outputs_fan_out(spark):
    got = {}
    rows = routing.tagged(spark.range(10), {"low": F.col("id") < 3, "high": F.col("id") > 7})
    writers.to_several(low=lambda d: got.update(low=d.count()), high=lambda d: got.update(high=d.count()), main=lambda d: got.update(main=d.count()))(rows, 0)
    assert got == {"low": 3, "high": 2, "main": 5}


def until(spark, stream, name, rows, tmp_path):
    """Processing time goes on for ever, so such a stream never reads all there is: it is stopped once it has given rows."""
    with processors.rocksdb(spark):
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(processingTime="1 second").start()
    end = time.time() + 30
    while time.time() < end and spark.table(name).count() < rows:
        time.sleep(0.5)
    query.stop()


def test_streams_of_files_and_batches_by_size_or_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.createDataFrame([(1, i, i) for i in range(5)] + [(2, 9, 9)], "user_id long, event_id long, ts long").coalesce(1).write.mode("append").parquet(str(folder))
    rows = spark.readStream.schema("user_id long, event_id long, ts long").parquet(str(folder))
    batches = processors.with_state(rows, "user_id", processors.Batcher(2, 1000), "user_id long, batch_id long, event_ids string", "ProcessingTime")
    until(spark, batches, "batches", 4, tmp_path)
    assert sorted(tuple(r) for r in spark.table("batches").collect()) == [(1, 0, "0,1"), (1, 1, "2,3"), (1, 2, "4"), (2, 0, "9")]


def test_expiring_state(spark, tmp_path):
    spark.createDataFrame([(1, i, i) for i in range(5)], "user_id long, event_id long, ts long").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("user_id long, event_id long, ts long").parquet(str(tmp_path / "in"))
    until(spark, processors.with_state(rows.selectExpr("user_id", "event_id", "ts", "cast(ts as double) value"), "user_id", processors.ExpiringLast(60_000), "user_id long, event_id long, value double, previous double", "ProcessingTime"), "ttl", 5, tmp_path)
    ttl = spark.table("ttl")
    assert sorted((r.event_id, r.previous) for r in ttl.collect() if r.user_id == 1) == [(0, None), (1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]


def test_restarts_and_options():
    tries = []

    class Query:
        def awaitTermination(self):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError("down")

    with_restarts(Query, attempts=3, pause_s=0)
    assert len(tries) == 3
    assert tables.kafka_options("h:1", "t", "g", committed_only=True) == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest", "kafka.group.id": "g", "kafka.isolation.level": "read_committed"}
