"""Histories of all counters against a plain model, and that only keys under a range delete meet it."""

import random
import re

import pytest

import __spark_entry__ as entry
from tests.test_whole_log import DATA, tables  # noqa: F401
from tidemark.operators import visibility
from tidemark.plans import catalog

PUT, DEL, RDEL, ADD = 1, 0, 2, 3
SCHEMA = "cf_id int, seq long, op int, key {0}, end_key {0}, value long, delta long"


def model(rows):
    """(cf_id, key, seq) -> value after the op, for keys that have ops."""
    out, now, known = {}, {}, {(r[0], r[3]) for r in rows if r[2] != RDEL}
    for cf, seq, op, key, end, value, delta in rows:
        hit = [k for k in known if k[0] == cf and key <= k[1] < end] if op == RDEL else [(cf, key)]
        for k in hit:
            now[k] = value if op == PUT else (now.get(k) or 0) + delta if op == ADD else None
            out[*k, seq] = now[k]
    return out


def random_log(n, as_key):
    rng, rows = random.Random(11), []
    for seq in range(1, n):
        op, key, wide = rng.choice([PUT, DEL, RDEL, ADD, ADD]), rng.randrange(0, 900, 3), rng.choice([1, 4, 500])
        rows.append((rng.randrange(1, 3), seq, op, as_key(key), as_key(key + wide) if op == RDEL else None, seq if op == PUT else None, seq if op == ADD else None))
    return rows


@pytest.mark.parametrize("kind,as_key", [("long", int), ("binary", lambda k: bytearray(b"k%04d" % k))])
@pytest.mark.parametrize("bits", [12, 2])
def test_model(spark, kind, as_key, bits, monkeypatch):
    monkeypatch.setattr(visibility, "BLOCK_BITS", bits)
    plain = lambda k: bytes(k) if isinstance(k, bytearray) else k
    rows = random_log(600, as_key)
    got = visibility.counter_history(spark.createDataFrame(rows, SCHEMA.format(kind))).collect()
    want = model([(cf, seq, op, plain(key), plain(end), value, delta) for cf, seq, op, key, end, value, delta in rows])
    assert len(got) == len(want) and {(r.cf_id, plain(r.key), r.seq): r.value for r in got} == want
    assert visibility.counter_history(spark.createDataFrame([], SCHEMA.format(kind))).count() == 0


def test_no_join_by_family_alone(spark):
    rows = random_log(50, int)
    plan = visibility.counter_history(spark.createDataFrame(rows, SCHEMA.format("long")))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert joins and not [x for x in joins if re.search(r"key#\d+L? [<>]|[<>]=? key#", x)]


def test_all_counters(spark, tables):  # noqa: F811
    rows = tables.sql(f"WITH {catalog._log_sql()} SELECT cf_id, seq, op, key, end_key, value, delta FROM log WHERE key >= 100 ORDER BY seq").fetchall()
    got = {(r.key, r.seq): r.value for r in entry.queries()["kv_counter_history_whole"](spark, DATA).where("key >= 105").collect()}
    assert got and got == {(key, seq): v for (_, key, seq), v in model(rows).items() if key >= 105}
