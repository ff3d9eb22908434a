"""Every query with SQL against DuckDB on the smallest tables: columns, types and rows."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(values):
    plain = [tuple(round(float(x), 4) if isinstance(x, float) else x for x in r) for r in values]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    want = duck.sql(entry_module.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert [TYPES[t] for _, t in sorted(df.dtypes)] == [str(want.types[i]) for i in at]
    assert rows(tuple(r[c] for c in columns) for r in df.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
