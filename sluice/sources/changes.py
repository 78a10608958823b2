"""A database table and the log of its changes as one stream: first the table as it stood at a mark, then every change after it."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "sluice_changes"


class Chunk(InputPartition):
    """Rows of the table with low <= key < high (None: no bound) as they stood at mark."""

    def __init__(self, low, high, mark: int):
        self.low, self.high, self.mark = low, high, mark


class Stretch(InputPartition):
    """Changes after position start, up to end."""

    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class ChangeReader(DataSourceStreamReader):
    """Offsets are a mark, a position in the log, or -1 before the table has been read. So a restart needs nothing but the query's checkpoint, and a batch that runs again gives the same rows.

    The batch that begins at -1 reads the table in chunks, whose bounds are found from its keys. A chunk's task reads its rows as they are, then the log's head, and takes back the changes
    between the mark and that head: what the first of them on a key shows as before is how the row stood at the mark. Writers may go on meanwhile; no lock is taken. Every batch after it reads a stretch of the log.
    """

    def __init__(self, options: dict):
        self.driver, self.connect = options["driver"], json.loads(options["connect"])
        self.table, self.key, self.log = options["table"], options["key"], options["log"]
        self.chunk = int(options.get("chunk", 10_000))

    def _connection(self):
        return closing(importlib.import_module(self.driver).connect(**self.connect))

    def _rows(self, connection, sql: str, values: tuple = ()) -> tuple[list[str], Iterator[tuple]]:
        """Columns and rows of sql, in which ? stands for a value."""
        if importlib.import_module(self.driver).paramstyle != "qmark":
            sql = sql.replace("?", "%s")
        cursor = connection.cursor()
        cursor.execute(sql, values)
        return [d[0] for d in cursor.description], cursor

    def _head(self, connection) -> int:
        return next(iter(self._rows(connection, f"SELECT max(pos) FROM {self.log}")[1]))[0] or 0

    def initialOffset(self) -> dict:
        return {"mark": -1}

    def latestOffset(self) -> dict:
        with self._connection() as connection:
            return {"mark": self._head(connection)}

    def _bounds(self) -> list:
        """Every chunk-th key of the table, in order, by one look-up each."""
        out = []
        with self._connection() as connection:
            while True:
                after = f"WHERE {self.key} >= ? " if out else ""
                found = list(self._rows(connection, f"SELECT {self.key} FROM {self.table} {after}ORDER BY {self.key} LIMIT 1 OFFSET {self.chunk}", tuple(out[-1:]))[1])
                if not found:
                    return out
                out.append(found[0][0])

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["mark"], end["mark"]
        if first < 0:
            bounds = [None, *self._bounds(), None]
            return [Chunk(low, high, last) for low, high in zip(bounds, bounds[1:], strict=False)]
        return [Stretch(at, min(at + self.chunk, last)) for at in range(first, last, self.chunk)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with self._connection() as connection:
            yield from self._chunk(connection, partition) if isinstance(partition, Chunk) else self._stretch(connection, partition)

    def _chunk(self, connection, part: Chunk) -> Iterator[tuple]:
        within = [(c, v) for c, v in ((">= ?", part.low), ("< ?", part.high)) if v is not None]
        bounds, values = "".join(f" AND {{0}} {c}" for c, _ in within), tuple(v for _, v in within)
        columns, found = self._rows(connection, f"SELECT * FROM {self.table} WHERE 1 = 1{bounds.format(self.key)}", values)
        at = columns.index(self.key)
        rows = {r[at]: dict(zip(columns, r, strict=True)) for r in found}
        head = self._head(connection)
        _, changed = self._rows(connection, f"SELECT k, row_before FROM {self.log} WHERE pos > ? AND pos <= ?{bounds.format('k')} ORDER BY pos DESC", (part.mark, head, *values))
        for key, before in changed:
            rows[key] = json.loads(before) if before else None
        for row in rows.values():
            if row is not None:
                yield part.mark, json.dumps({"op": "r", "before": None, "after": row, "source": {"ts_ms": 0, "pos": part.mark}}, default=str)

    def _stretch(self, connection, part: Stretch) -> Iterator[tuple]:
        _, found = self._rows(connection, f"SELECT pos, op, row_before, row_after, ts_ms FROM {self.log} WHERE pos > ? AND pos <= ? ORDER BY pos", (part.start, part.end))
        for pos, op, before, after, ts_ms in found:
            yield pos, json.dumps({"op": op, "before": before and json.loads(before), "after": after and json.loads(after), "source": {"ts_ms": ts_ms, "pos": pos}})

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "pos long, value string"

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(dict(self.options))


def change_stream(spark: SparkSession, driver: str, connect: dict, table: str, key: str, log: str, chunk: int = 10_000) -> DataFrame:
    """pos and value (a change event in JSON, see operators.cdc.parsed_changes) of a table and of all its changes from now on.

    driver is the name of a DB-API module that executors have, connect the arguments of its connect(). The table has a unique key that is not null. The log, a table, has pos (ascending whole numbers from 1, visible in that
    order, as a log written at commit has them), k (the changed row's key; a change of key is a deletion and an insertion), op (c, u or d), row_before and row_after (JSON, null where there is none) and ts_ms. It is kept as long as a query may have to go back to.
    Rows of the table come with op r. chunk: rows of a task of the first batch, and changes of a task of later ones; a chunk's rows are in memory.
    """
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(FORMAT).options(driver=driver, connect=json.dumps(connect), table=table, key=key, log=log, chunk=str(chunk)).load()
