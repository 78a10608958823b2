"""Stateful processors for transformWithState, and the streams that use them.

Rows of a batch are sorted before use, as shuffles do not keep order; so what one key has in one batch is in memory, and sources bound their batches.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _by(*columns: str):
    """An order of rows by columns, nulls first as in Spark's own."""
    return lambda r: tuple((r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in columns)


class ChangeAlarm(StatefulProcessor):
    """Rows whose value differs from the key's one before, 0 at first, by more than most. A null value raises no alarm, nor does the row after it."""

    def __init__(self, most: float):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        previous = self.last.get()[0] if self.last.exists() else 0.0
        for r in sorted(rows, key=_by("ts", "event_id")):
            if r.value is not None and previous is not None and abs(r.value - previous) > self.most:
                yield Row(user_id=key[0], event_id=r.event_id, value=r.value, previous=previous)
            previous = r.value
        self.last.update((previous,))

    def close(self) -> None:
        pass


class LateSplit(StatefulProcessor):
    """Every row with out_tag main, or late if its time is over delay_s before the largest the key has shown in earlier arrivals.

    Lateness is kept per key and row by row; a watermark would drop late rows before they got here. A row without a time is not late and moves nothing.
    """

    def __init__(self, delay_s: int):
        self.delay_us = delay_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        top = self.top.get()[0] if self.top.exists() else None
        for r in sorted(rows, key=_by("arrival", "event_id")):
            late = top is not None and r.us is not None and r.us < top - self.delay_us
            yield Row(user_id=key[0], event_id=r.event_id, out_tag="late" if late else "main")
            top = max((x for x in (top, r.us) if x is not None), default=None)
        if top is not None:
            self.top.update((top,))

    def close(self) -> None:
        pass


class ExpiringLast(StatefulProcessor):
    """Each row's id and value with the key's value before, which is forgotten ttl_ms of processing time after it was written. A null value is a value."""

    def __init__(self, ttl_ms: int, key: str = "user_id", id: str = "event_id", value: str = "value", time: str = "ts"):
        self.ttl_ms, self.key, self.id, self.value, self.time = ttl_ms, key, id, value, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=_by(self.time, self.id)):
            previous = self.last.get()[0] if self.last.exists() else None
            self.last.update((r[self.value],))
            yield Row(**{self.key: key[0], self.id: r[self.id], self.value: r[self.value], "previous": previous})

    def close(self) -> None:
        pass


class RunningTop(StatefulProcessor):
    """Each row with the key's n largest whole numbers so far, largest first, joined by commas. A null value changes nothing."""

    def __init__(self, n: int, key: str = "user_id", id: str = "event_id", value: str = "cents", time: str = "ts"):
        self.n, self.key, self.id, self.value, self.time = n, key, id, value, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", "value long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = [r[0] for r in self.best.get()] if self.best.exists() else []
        for r in sorted(rows, key=_by(self.time, self.id)):
            if r[self.value] is not None:
                best = sorted([*best, r[self.value]], reverse=True)[: self.n]
            yield Row(**{self.id: r[self.id], self.key: key[0], "top": ",".join(map(str, best))})
        if best:
            self.best.put([(b,) for b in best])

    def close(self) -> None:
        pass


class KindCounts(StatefulProcessor):
    """Each row with how many of its kind the key has had so far. Rows of no kind are a kind."""

    def __init__(self, key: str = "user_id", id: str = "event_id", kind: str = "event_type", time: str = "ts"):
        self.key, self.id, self.kind, self.time = key, id, kind, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "kind string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts: dict[str | None, int] = {}  # of this batch's kinds: the state is asked and told once for each, not for each row
        for r in sorted(rows, key=_by(self.time, self.id)):
            kind = r[self.kind]
            if kind not in counts:
                counts[kind] = self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0
            counts[kind] += 1
            yield Row(**{self.id: r[self.id], self.key: key[0], self.kind: kind, "n": counts[kind]})
        for kind, n in counts.items():
            self.counts.updateValue((kind,), (n,))

    def close(self) -> None:
        pass


class LateWindows(StatefulProcessor):
    """Tumbling windows that stay open for late rows: a row for each firing, and a row for each row that came too late for its window.

    A key has a watermark of its own, delay_s behind the latest time it has shown; it moves with every row in the order of arrival. A window fires first when the
    watermark passes its end, and again at once with every row that it gets afterwards. Rows whose window ended lateness_s or more before the watermark are late: they go out as such and change nothing, as do rows without a time.
    Windows are forgotten then. Those of keys that fall silent are fired, if they have not been, and forgotten by a timer once the stream's watermark is lateness_s past their end; its delay must cover the disorder of arrivals.

    Rows in: us (time in microseconds), value (a whole number; null adds nothing), and the columns order and id. Rows out: key, out_tag (main, late), window_us, firing (from 1), n, total, elements (ids in order of arrival), id.
    """

    SCHEMA = "out_tag string, window_us long, firing long, n long, total long, elements string"

    def __init__(self, width_s: int, delay_s: int, lateness_s: int, key: str = "user_id", id: str = "event_id", order: str = "arrival"):
        self.width, self.delay, self.lateness = (s * 1_000_000 for s in (width_s, delay_s, lateness_s))
        self.key, self.id, self.order = key, id, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", "us long")
        self.open = handle.getMapState("open", "window_us long", "firing long, total long, ids array<bigint>")

    def _fired(self, key, at: int, held: list, late=None) -> Row:
        main = (held[0], len(held[2]), held[1], ",".join(map(str, held[2]))) if late is None else (None, None, None, None)
        return Row(**{self.key: key[0], "out_tag": "main" if late is None else "late", "window_us": at, **dict(zip(("firing", "n", "total", "elements"), main, strict=True)), self.id: late})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        top = self.top.get()[0] if self.top.exists() else None
        open_ = {k[0]: [v[0], v[1], list(v[2])] for k, v in self.open.iterator()}
        known, before = set(open_), dict.fromkeys(open_)
        for r in sorted(rows, key=_by(self.order, self.id)):
            mark = None if top is None else top - self.delay
            at = None if r.us is None else r.us - r.us % self.width
            if at is None or (mark is not None and at + self.width + self.lateness <= mark):
                yield self._fired(key, at, [], r[self.id])
            else:
                held = open_.setdefault(at, [0, 0, []])
                held[1] += r.value or 0
                held[2].append(r[self.id])
                if mark is not None and at + self.width <= mark:
                    held[0] += 1
                    yield self._fired(key, at, held)
            if r.us is not None and (top is None or r.us > top):
                top = r.us
                for w in sorted(open_):
                    if w + self.width <= top - self.delay and open_[w][0] == 0:
                        open_[w][0] = 1
                        yield self._fired(key, w, open_[w])
                for w in [w for w in open_ if w + self.width + self.lateness <= top - self.delay]:
                    del open_[w]
        for w in before:
            if w not in open_:
                self.open.removeKey((w,))
        for w, held in open_.items():
            self.open.updateValue((w,), tuple(held))
            if w not in known:
                self.handle.registerTimer((w + self.width + self.lateness) // 1000)
        if top is not None:
            self.top.update((top,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
        over = [(k[0], [v[0], v[1], list(v[2])]) for k, v in self.open.iterator() if k[0] + self.width + self.lateness <= passed]
        for w, held in sorted(over):
            if held[0] == 0:
                held[0] = 1
                yield self._fired(key, w, held)
            self.open.removeKey((w,))

    def close(self) -> None:
        pass


class TwoInputs(StatefulProcessor):
    """Two streams of one key, as rows with side left or right: each right row with the left rows of its key that arrived before it and, with both, each left row with the right rows before it.

    Rows remembered are forgotten once the key has shown a time over keep_s after theirs, and ttl_ms of processing time after they came; neither by default. Rows without a time are kept until the latter.
    Rows in: side, us (time in microseconds), and the columns order and id. Rows out: key, left_id and right_id.
    """

    SCHEMA = "left_id long, right_id long"

    def __init__(self, both: bool = False, keep_s: int | None = None, ttl_ms: int | None = None, key: str = "user_id", id: str = "event_id", order: str = "arrival"):
        self.both, self.keep, self.ttl_ms, self.key, self.id, self.order = both, None if keep_s is None else keep_s * 1_000_000, ttl_ms, key, id, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        lists = {side: handle.getListState(side, "id long, us long", self.ttl_ms) for side in ("left", "right")}
        self.lists = lists if self.both else {"left": lists["left"]}
        self.top = handle.getValueState("top", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {side: [(r[0], r[1]) for r in state.get()] if state.exists() else [] for side, state in self.lists.items()}
        had = {side: len(x) for side, x in held.items()}
        top = self.top.get()[0] if self.top.exists() else None
        alive = lambda us: self.keep is None or us is None or top is None or us >= top - self.keep
        for r in sorted(rows, key=_by(self.order, self.id)):
            other = "left" if r.side == "right" else "right"
            for id_, us in held.get(other, ()):
                if alive(us):
                    left, right = (id_, r[self.id]) if other == "left" else (r[self.id], id_)
                    yield Row(**{self.key: key[0], "left_id": left, "right_id": right})
            if r.side in held:
                held[r.side].append((r[self.id], r.us))
            top = max((x for x in (top, r.us) if x is not None), default=None)
        for side, state in self.lists.items():
            new = held[side][had[side] :]
            if all(alive(us) for _, us in held[side]):
                if new:
                    state.appendList(new)
            elif kept := [x for x in held[side] if alive(x[1])]:
                state.put(kept)
            else:
                state.clear()
        if top is not None and self.keep is not None:
            self.top.update((top,))

    def close(self) -> None:
        pass


class Controlled(StatefulProcessor):
    """Data rows whose value is above the latest control value that arrived before them, default before any, with it as threshold.

    Every shard of the data has a copy of the control state: control rows are dealt to all shards (see dealt()), data rows to one. The state is kept over batches and restarts,
    and within a batch rows meet it in the order of arrival, whole numbers as the ids are. Null control values change nothing; null data values pass no threshold.
    """

    SCHEMA = "event_id long, value double, threshold double"

    def __init__(self, default: float = 0.0, id: str = "event_id", order: str = "event_id"):
        self.default, self.id, self.order = default, id, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.control = handle.getValueState("control", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        threshold = self.control.get()[0] if self.control.exists() else None
        # Every shard has all control rows: of a row a few numbers stay, in arrays.
        orders, ids, values, control = (array("q"), bytearray()), (array("q"), bytearray()), array("d"), bytearray()
        columns = [(self.order, orders)] if self.order == self.id else [(self.order, orders), (self.id, ids)]
        for r in rows:
            if r.value is None:
                continue
            for name, (numbers, there) in columns:
                numbers.append(0 if r[name] is None else r[name])
                there.append(r[name] is not None)
            values.append(r.value)
            control.append(bool(r.control))
        if not values:
            return
        # Sorted by order, then id, nulls first; of each place the last control row up to it.
        keys = [x for _, (numbers, there) in reversed(columns) for x in (np.frombuffer(numbers, np.int64), np.frombuffer(there, np.uint8))]
        at = np.lexsort(keys)
        value, is_control = np.frombuffer(values)[at], np.frombuffer(control, np.uint8)[at] == 1
        last = np.maximum.accumulate(np.where(is_control, np.arange(len(at)), -1))
        now = np.where(last < 0, self.default if threshold is None else threshold, value[last])
        numbers, there = columns[-1][1]
        for k in np.nonzero(~is_control & (value > now))[0].tolist():
            yield Row(**{self.id: numbers[at[k]] if there[at[k]] else None, "value": float(value[k]), "threshold": float(now[k])})
        if last[-1] >= 0:
            self.control.update((float(value[last[-1]]),))

    def close(self) -> None:
        pass


def dealt(rows: DataFrame, control: Column, id: str, shards: int = 64) -> DataFrame:
    """rows with control and shard: data rows in one shard, by a hash of id, control rows in each of shards."""
    every = F.array(*[F.lit(k) for k in range(shards)])
    own = F.array(F.pmod(F.xxhash64(id), F.lit(shards)).cast("int"))
    return rows.withColumn("control", control).withColumn("shard", F.explode(F.when(F.col("control"), every).otherwise(own)))


class WindowTop(StatefulProcessor):
    """The n largest counts of a window, ties to the smaller kind, once event time is past its end: rows gather in a list and a timer in event time lets them out."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "n long, kind string, start timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            self.held.appendValue((r.n, r.event_type, r.window_start))
        self.handle.registerTimer(key[0] + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = sorted(((r[0], r[1], r[2]) for r in self.held.get()), key=lambda r: (-r[0], r[1])) if self.held.exists() else []
        self.held.clear()
        for rank, (n, kind, start) in enumerate(held[: self.n], 1):
            yield Row(window_start=start, rank=rank, event_type=kind, n=n)

    def close(self) -> None:
        pass


class ArrivalWindows(StatefulProcessor):
    """Windows of arrival: the first row of a key opens one, and a timer in processing time closes it width_ms later. Rows out: key, opened_ms, n, first and last id in order, and elements (ids joined by commas)."""

    SCHEMA = "opened_ms long, n long, first_id long, last_id long, elements string"

    def __init__(self, width_ms: int, key: str = "user_id", id: str = "event_id", order: str = "ts"):
        self.width_ms, self.key, self.id, self.order = width_ms, key, id, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id long")
        self.opened = handle.getValueState("opened", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self.held.appendList([(r[self.id],) for r in sorted(rows, key=_by(self.order, self.id))])
        if not self.opened.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            self.opened.update((now,))
            self.handle.registerTimer(now + self.width_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ids = [r[0] for r in self.held.get()]
        yield Row(**{self.key: key[0], "opened_ms": self.opened.get()[0], "n": len(ids), "first_id": ids[0], "last_id": ids[-1], "elements": ",".join(map(str, ids))})
        self.held.clear()
        self.opened.clear()

    def close(self) -> None:
        pass


class Batcher(StatefulProcessor):
    """Batches of size events of a key, or of what there is after wait_ms: rows batch_id and event_ids."""

    def __init__(self, size: int, wait_ms: int):
        self.size, self.wait_ms = size, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event_id long")
        self.number = handle.getValueState("number", "n long, timer long")

    def _flush(self, key, held: list[int], number: int, timer: int) -> Row:
        if timer:
            self.handle.deleteTimer(timer)
        self.held.clear()
        self.number.update((number + 1, 0))
        return Row(user_id=key[0], batch_id=number, event_ids=",".join(map(str, held)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        number, timer = self.number.get() if self.number.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
            held.append(r.event_id)
            if len(held) >= self.size:
                yield self._flush(key, held, number, timer)
                held, number, timer = [], number + 1, 0
        if held:
            if not timer:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                self.handle.registerTimer(timer)
            self.held.put([(h,) for h in held])
            self.number.update((number, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        if held:
            number, _ = self.number.get()
            yield self._flush(key, held, number, 0)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """State stores of queries that start in here are ROCKSDB, which processors need; afterwards the session's setting is as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time_mode: str = "None") -> DataFrame:
    """rows through processor, key by key, in append mode. Start the query in rocksdb(), as drained() does."""
    return rows.groupBy(key).transformWithState(processor, schema, "append", time_mode)
