"""Queries over the whole log against SQL and a plain model."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.01"
WHOLE = sorted(n for n in catalog.QUERIES if n.endswith("_whole"))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def ops(tables):
    return tables.sql(f"WITH {catalog._log_sql()} SELECT seq, op, key, end_key, value FROM log ORDER BY seq").fetchall()


@pytest.mark.parametrize("name", WHOLE)
def test_equals_sql(spark, tables, name):
    got, want = entry.queries()[name](spark, DATA), tables.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_every_op_counts(spark, tables):
    live, lost, newest, rows = {}, set(), {}, ops(tables)
    for seq, op, key, end, value in rows:
        if op in (0, 1):
            newest[key] = (seq, op)
        if op == 1:
            live[key] = (seq, value)
        for k in [key] if op == 0 else range(key, end) if op == 2 else []:
            live.pop(k, None)
    lost = {k for k, (_, op) in newest.items() if op == 1 and k not in live}
    assert any(seq * 10 > rows[-1][0] * 9 for seq, _ in live.values())  # the last tenth counts
    queries = entry.queries()
    assert {r.key: (r.seq, r.value) for r in queries["kv_live_swept_whole"](spark, DATA).collect()} == live
    assert {r.key: (r.seq, r.value) for r in queries["kv_compact_live_whole"](spark, DATA).collect()} == live
    assert {(r.key, r.problem) for r in queries["kv_verify_model_whole"](spark, DATA).collect()} == {(k, "lost") for k in lost}
    kept = {r.seq for r in queries["kv_compact_survivors_whole"](spark, DATA).collect() if r.op != 2}
    newest_any = {}
    for seq, op, key, *_ in rows:
        if op != 3:
            newest_any[key] = (seq, op)
    assert kept == {seq for seq, op in newest_any.values() if op == 1}
