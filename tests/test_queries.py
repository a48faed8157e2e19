"""Every query that has SQL equals it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, tables, name):
    got, want = entry.queries()[name](spark, DATA), tables.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(values, names):
        at = [names.index(c) for c in columns]
        return sorted((tuple(round(v[i], 6) if isinstance(v[i], float) else v[i] for i in at) for v in values), key=repr)

    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
