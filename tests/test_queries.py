"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from offerloom.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert rows == want
