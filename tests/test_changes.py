"""The change source: a table while it is being written, restarts, and a process that is killed."""

import json
import os
import random
import signal
import sqlite3
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluice import catalog
from sluice.operators import cdc
from sluice.sources.changes import Chunk, ChangeReader, change_stream

from .test_catalog import SF

SCHEMA = "id long, seq long, price double"


class Database:
    """A table t (id, seq, price) and its log, in a file."""

    def __init__(self, path):
        self.path = str(path)
        with self.open() as c:
            c.execute("PRAGMA journal_mode = wal")
            c.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, seq INTEGER, price REAL)")
            c.execute("CREATE TABLE log (pos INTEGER PRIMARY KEY AUTOINCREMENT, k INTEGER, op TEXT, row_before TEXT, row_after TEXT, ts_ms INTEGER)")

    def open(self):
        return sqlite3.connect(self.path, timeout=60)

    def change(self, changes):
        """Apply (id, seq, op, price), each in its transaction: c and u put a row, d takes it away."""
        c = self.open()
        for id_, seq, op, price in changes:
            with c:
                had = c.execute("SELECT id, seq, price FROM t WHERE id = ?", (id_,)).fetchone()
                before = json.dumps(dict(zip(("id", "seq", "price"), had, strict=True))) if had else None
                c.execute("DELETE FROM t WHERE id = ?", (id_,))
                if op != "d":
                    c.execute("INSERT INTO t VALUES (?, ?, ?)", (id_, seq, price))
                elif not had:
                    continue
                after = None if op == "d" else json.dumps({"id": id_, "seq": seq, "price": price})
                c.execute("INSERT INTO log (k, op, row_before, row_after, ts_ms) VALUES (?, ?, ?, ?, ?)", (id_, "d" if op == "d" else "u" if had else "c", before, after, seq))
        c.close()

    def rows(self):
        with self.open() as c:
            return sorted(c.execute("SELECT id, seq, price FROM t"))

    def head(self):
        with self.open() as c:
            return c.execute("SELECT coalesce(max(pos), 0) FROM log").fetchone()[0]

    def options(self, chunk):
        return {"driver": "sqlite3", "connect": {"database": self.path, "timeout": 60}, "table": "t", "key": "id", "log": "log", "chunk": chunk}


def started(spark, database, home, chunk=40):
    """The stream into a folder for each batch, so that a batch that runs again writes the same place."""

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{home}/out/batch={batch}")

    stream = change_stream(spark, **database.options(chunk))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(processingTime="200 milliseconds").start()


def until(query, holds, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not holds():
        if query is not None and query.exception():
            raise query.exception()
        time.sleep(0.1)
    assert holds()


def read_to(spark, home):
    """The highest position that a committed batch has; a batch that is not may be written again at any time."""
    done = [p for p in Path(f"{home}/out").glob("batch=*") if Path(f"{home}/state/commits/{p.name.partition('=')[2]}").exists()]
    return max((spark.read.parquet(str(p)).agg(F.max("pos")).first()[0] or 0 for p in done), default=-1)


def state_of(spark, home):
    events = spark.read.parquet(f"{home}/out")
    parsed = cdc.parsed_changes(events.select("value"), SCHEMA)
    keyed = events.select("pos", F.get_json_object("value", "$.op").alias("op"), F.from_json(F.coalesce(F.get_json_object("value", "$.after"), F.get_json_object("value", "$.before")), SCHEMA).alias("row"))
    assert parsed.where("row is null or op is null").count() == 0
    rows = keyed.select("pos", "op", "row.*")
    return sorted(tuple(r) for r in cdc.latest_state(rows, "id", "pos").select("id", "seq", "price").collect()), rows


def changes_at_random(rng, n, seq=0, ids=400):
    return [(rng.randrange(ids), seq + i, rng.choice("ccud"), float(rng.randrange(1000))) for i in range(n)]


def test_table_then_changes_without_gap_or_repeat(spark, tmp_path):
    rng, database = random.Random(1), Database(tmp_path / "db")
    database.change(changes_at_random(rng, 900))
    going = threading.Event()

    def go_on():
        seq = 1000
        while not going.is_set():
            database.change(changes_at_random(rng, 5, seq))
            seq += 5

    writer = threading.Thread(target=go_on)
    writer.start()
    query = started(spark, database, tmp_path)
    until(query, lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 2)
    query.stop()
    query = started(spark, database, tmp_path)  # goes on where its checkpoint is
    until(query, lambda: query.lastProgress is not None and query.lastProgress["batchId"] >= 4)
    going.set()
    writer.join()
    head = database.head()
    until(query, lambda: read_to(spark, tmp_path) >= head)
    query.stop()
    state, rows = state_of(spark, tmp_path)
    assert state == database.rows()
    mark = rows.where("op = 'r'").agg(F.max("pos")).first()[0]
    assert rows.where("op = 'r'").select("id").distinct().count() == rows.where("op = 'r'").count()
    later = [r.pos for r in rows.where("op != 'r'").orderBy("pos").collect()]
    assert later == list(range(mark + 1, head + 1)) and mark > 0


def test_a_chunk_is_as_it_stood_at_the_mark(tmp_path):
    rng, database = random.Random(2), Database(tmp_path / "db")
    database.change(changes_at_random(rng, 600))
    then, mark = database.rows(), database.head()
    reader = ChangeReader({k: json.dumps(v) if isinstance(v, dict) else v for k, v in database.options(37).items()})
    database.change([*changes_at_random(rng, 600, 600), (9_999, 1, "c", 1.0), (-5, 1, "c", 1.0)])
    parts = reader.partitions(reader.initialOffset(), {"mark": mark})
    assert len(parts) > 5 and all(isinstance(p, Chunk) for p in parts)
    got = [json.loads(value)["after"] for p in parts for _, value in reader.read(p)]
    assert sorted((r["id"], r["seq"], r["price"]) for r in got) == then
    assert [(p.start, p.end) for p in reader.partitions({"mark": mark}, {"mark": mark + 80})] == [(mark, mark + 37), (mark + 37, mark + 74), (mark + 74, mark + 80)]
    assert reader.partitions({"mark": mark}, {"mark": mark}) == []


def test_an_empty_table_and_log(spark, tmp_path):
    database = Database(tmp_path / "db")
    query = started(spark, database, tmp_path)
    until(query, lambda: query.lastProgress is not None)
    database.change([(1, 1, "c", 2.0), (1, 2, "d", 0.0), (2, 3, "c", 4.0)])
    until(query, lambda: read_to(spark, tmp_path) == 3)
    query.stop()
    assert state_of(spark, tmp_path)[0] == [(2, 3, 4.0)]


CHILD = """
import sys, time
from pyspark.sql import SparkSession
from sluice.sources.changes import change_stream
home, path = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def write(df, batch):
    df.write.mode("overwrite").parquet(f"{home}/out/batch={batch}")
    if batch == 2:
        open(f"{home}/written", "w").close()
        time.sleep(600)  # killed here: the rows of this batch stand there, its checkpoint does not
stream = change_stream(spark, "sqlite3", {"database": path, "timeout": 60}, "t", "id", "log", 40)
stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/state").trigger(processingTime="200 milliseconds").start().awaitTermination()
"""


def test_a_killed_process_goes_on_where_it_was(spark, tmp_path):
    """Orders as changes of customers, as the query cdc_apply has them: applied to a table while a process that is killed follows it, and another session after it."""
    changes = catalog.QUERIES["cdc_apply"].__globals__["_changes"](spark, SF).orderBy("seq").collect()
    changes = [(r.id, r.seq, r.op, float(r.price)) for r in changes]
    database = Database(tmp_path / "db")
    database.change(changes[:500])
    (tmp_path / "child.py").write_text(CHILD)
    root = str(Path(__file__).parent.parent)
    child = subprocess.Popen([sys.executable, str(tmp_path / "child.py"), str(tmp_path), database.path], cwd=root, env=os.environ | {"PYTHONPATH": root}, start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    try:
        at, end = 500, time.time() + 120
        while not (tmp_path / "written").exists() and time.time() < end:
            if at < 1000 and (tmp_path / "out" / "batch=0" / "_SUCCESS").exists():
                database.change(changes[at : at + 20])
                at += 20
            time.sleep(0.1)
        assert (tmp_path / "written").exists()
    finally:
        os.killpg(child.pid, signal.SIGKILL)
        child.wait()
    database.change(changes[at:])
    query = started(spark, database, tmp_path)
    head = database.head()
    until(query, lambda: read_to(spark, tmp_path) >= head)
    query.stop()
    expected = sorted((r.id, r.seq, float(r.price)) for r in catalog.QUERIES["cdc_apply"](spark, SF).collect())
    state, rows = state_of(spark, tmp_path)
    assert state == expected == database.rows()
    assert rows.where("op != 'r'").groupBy("pos").count().where("count > 1").count() == 0


@pytest.mark.parametrize("style", ["format", "qmark"])
def test_values_in_the_style_of_the_driver(style, monkeypatch, tmp_path):
    database = Database(tmp_path / "db")
    database.change([(1, 1, "c", 2.0)])
    reader = ChangeReader({k: json.dumps(v) if isinstance(v, dict) else v for k, v in database.options(10).items()})
    monkeypatch.setattr(sqlite3, "paramstyle", style)
    seen = []

    class Cursor:
        description = [("pos",)]

        def execute(self, sql, values):
            seen.append(sql)

    class Connection:
        cursor = staticmethod(Cursor)

    reader._rows(Connection, "SELECT pos FROM log WHERE pos > ?", (1,))
    assert seen == [f"SELECT pos FROM log WHERE pos > {'%s' if style == 'format' else '?'}"]
