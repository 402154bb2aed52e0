"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sourcelight.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr([plain(r[i]) for i in order]) for r in rows))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = table(df.columns, df.collect())
    if name not in ORACLES:
        assert got[1]
        return
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert got == table(columns, result.fetchall())
