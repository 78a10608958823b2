"""Aggregates of one's own: created, added to and merged by functions, in two phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Aggregate:
    """create() makes an accumulator, a tuple of the columns of state; add(accumulator, *values) and merge(one, other) give a new one; result(accumulator) gives a tuple of the columns of out.

    Both are DDL. merge must not depend on the order of what it merges.
    """

    create: Callable[[], tuple]
    add: Callable[..., tuple]
    merge: Callable[[tuple, tuple], tuple]
    result: Callable[[tuple], tuple]
    state: str
    out: str


def aggregated(df: DataFrame, keys: list[str], values: list[str], aggregate: Aggregate, held: int = 100_000) -> DataFrame:
    """keys and the columns of aggregate.out, a row for each group of df. Null is a key like any other; what null values do is add's affair. An empty table gives no row.

    Every task adds its rows to accumulators first and hands on one for each group (more, if it sees over held groups, after each held of them), so what is shuffled grows with
    tasks and groups, not with rows. Accumulators of a group then meet in order of the keys and are merged one by one: a group of any size has one accumulator in memory.
    """
    key_fields = list(df.select(*keys).schema)
    middle, final = (T.StructType([*key_fields, *T.DataType.fromDDL(ddl)]) for ddl in (aggregate.state, aggregate.out))
    n = len(keys)

    def batch_of(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
        arrow = to_arrow_schema(schema)
        columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def tuples(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple] = {}
        for batch in batches:
            for row in tuples(batch):
                key = row[:n]
                groups[key] = aggregate.add(groups[key] if key in groups else aggregate.create(), *row[n:])
            if len(groups) > held:
                yield batch_of([(*k, *a) for k, a in groups.items()], middle)
                groups = {}
        yield batch_of([(*k, *a) for k, a in groups.items()], middle)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for row in tuples(batch):
                key, part = row[:n], row[n:]
                if state is not None and key == at:
                    state = aggregate.merge(state, part)
                else:
                    if state is not None:
                        out.append((*at, *aggregate.result(state)))
                    at, state = key, part
            yield batch_of(out, final)
        if state is not None:
            yield batch_of([(*at, *aggregate.result(state))], final)

    parts = df.select(*keys, *values).mapInArrow(partial, middle)
    dealt = parts.repartition(*keys) if keys else parts.repartition(1, F.lit(0))
    return dealt.sortWithinPartitions(*keys).mapInArrow(merged, final) if keys else dealt.mapInArrow(merged, final)


def _trimmed(state: tuple) -> tuple:
    n, total, low, high = state
    return (n, (total - low - high) / (n - 2) if n > 2 else None)


#: The mean of whole numbers without the least and the greatest of them; null for fewer than three. Nulls add nothing.
TRIMMED_MEAN = Aggregate(
    create=lambda: (0, 0, None, None),
    add=lambda s, v: s if v is None else (s[0] + 1, s[1] + v, v if s[2] is None else min(s[2], v), v if s[3] is None else max(s[3], v)),
    merge=lambda s, t: (s[0] + t[0], s[1] + t[1], *(best((x for x in pair if x is not None), default=None) for best, pair in ((min, (s[2], t[2])), (max, (s[3], t[3]))))),
    result=_trimmed,
    state="n bigint, total bigint, low bigint, high bigint",
    out="n bigint, trimmed double",
)
