"""Registered queries with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from offerloom.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    df = QUERIES[name](spark, FOLDER)
    result = c.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in theirs) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)
