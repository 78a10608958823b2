"""Every registered query of the library's own against its SQL."""

import collections
import math
import os

import duckdb
import pytest

from sluice import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    same = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(columns), collections.Counter(tuple(same(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, os.environ.get("SF_DIR", SF))
    theirs = duck.execute(catalog.ORACLES[name])
    expected = rows([d[0] for d in theirs.description], theirs.fetchall())
    assert rows(df.columns, map(tuple, df.collect())) == expected
    assert sum(expected[1].values()) > 0
