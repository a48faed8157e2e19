"""Hand-checked cases of visibility, reads and counters, and a random model."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.codec import from_little_endian, little_endian, prefix_end, wrapping_sum
from tidemark.operators import maintenance, reads, visibility
from tidemark.sources.oplog import OP_LOG, numbered, validated

PUT, DEL, RDEL, ADD = 1, 0, 2, 3


def log(spark, ops):
    """(op, key, value or end or delta[, family]) in order of sequence."""
    rows = []
    for i, (op, key, arg, *cf) in enumerate(ops, 1):
        rows.append((cf[0] if cf else 1, i, op, bytearray(key), bytearray(arg) if op == RDEL else None, bytearray(arg) if op == PUT else None, arg if op == ADD else None, 1, i))
    return spark.createDataFrame(rows, OP_LOG)


def live(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.orderBy("key").collect()]


@pytest.mark.parametrize("strategy", ["broadcast", "sweep"])
def test_range_deletes(spark, strategy):
    df = log(spark, [(PUT, b"a", b"1"), (PUT, b"b", b"2"), (PUT, b"z", b"3"), (RDEL, b"b", b"z"), (PUT, b"c", b"4"), (PUT, b"d", b""), (RDEL, b"d", b"e"), (PUT, b"d", b"")])
    assert live(visibility.visible(df, 3, strategy)) == [(b"a", b"1"), (b"b", b"2"), (b"z", b"3")]
    assert live(visibility.visible(df, 4, strategy)) == [(b"a", b"1"), (b"z", b"3")]
    assert live(visibility.visible(df, None, strategy)) == [(b"a", b"1"), (b"c", b"4"), (b"d", b""), (b"z", b"3")]


def test_families_are_apart(spark):
    df = log(spark, [(PUT, b"k", b"1", 1), (PUT, b"k", b"2", 2), (RDEL, b"a", b"z", 2)])
    assert [(r.cf_id, bytes(r.value)) for r in visibility.visible(df).collect()] == [(1, b"1")]


def test_reads(spark):
    df = log(spark, [(PUT, k, k) for k in (b"a:001", b"a:002", b"b:001", b"b:002", b"c:001")] + [(DEL, b"a:002", b"")])
    keys = lambda d: [bytes(r.key) for r in d.collect()]
    assert keys(reads.scan(df, prefix=b"b:")) == [b"b:001", b"b:002"]
    assert keys(reads.scan(df, reverse=True)) == [b"c:001", b"b:002", b"b:001", b"a:001"]
    assert keys(reads.seek(df, b"a:002")) == [b"b:001"]
    assert keys(reads.seek_for_prev(df, b"a:002")) == [b"a:001"]
    assert keys(reads.seek_for_prev(df, b"Z")) == []
    assert [r.value and bytes(r.value) for r in reads.multi_get(df, [b"c:001", b"nope", b"c:001", b"a:002"]).collect()] == [b"c:001", None, b"c:001", None]
    rows, more = reads.limited_scan(df, 2)
    assert more and rows.count() == 2
    assert [bytes(r.value) for r in reads.get(df, b"a:002", seq=5).collect()] == [b"a:002"]
    with pytest.raises(ValueError):
        reads.multi_get(df, [None])


def test_validation_and_numbers(spark):
    bad = log(spark, [(RDEL, b"z", b"a")])
    with pytest.raises(Exception, match="above its begin"):
        validated(bad).collect()
    batches = spark.createDataFrame([(2, 1), (1, 2), (1, 1), (9000, 1)], "batch_id long, op_index int")
    assert sorted((r.batch_id, r.op_index, r.seq) for r in numbered(batches, 10).collect()) == [(1, 1, 11), (1, 2, 12), (2, 1, 13), (9000, 1, 14)]


def test_codecs(spark):
    row = spark.range(1).select(from_little_endian(little_endian(F.lit(-2).cast("long"))).alias("x")).head()
    assert row.x == -2
    wrapped = spark.createDataFrame([(2**63 - 1,), (6,)], "d long").agg(wrapping_sum(F.col("d")).alias("s")).head().s
    assert wrapped == -(2**63) + 5
    assert prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None


def test_random_model(spark):
    rng = random.Random(5)
    rows, values, counters = [], {}, {}
    for seq in range(1, 400):
        op, key = rng.choice([PUT, PUT, DEL, RDEL, ADD]), rng.randrange(30)
        end = key + rng.randrange(1, 6)
        rows.append((1, seq, op, key, end if op == RDEL else None, seq if op == PUT else None, seq if op == ADD else None))
        if op == PUT:
            values[key] = counters[key] = seq
        elif op == ADD:
            counters[key] = counters.get(key, 0) + seq
        for k in [key] if op == DEL else range(key, end) if op == RDEL else []:
            values.pop(k, None), counters.pop(k, None)
    df = spark.createDataFrame(rows, "cf_id int, seq long, op int, key long, end_key long, value long, delta long")
    for strategy in ("broadcast", "sweep"):
        assert {r.key: r.value for r in visibility.visible(df, None, strategy).collect()} == values
        assert {r.key: r.value for r in visibility.counters(df, None, strategy).collect()} == counters
    last = {}
    for r in visibility.counter_history(df).orderBy("seq").collect():
        last[r.key] = r.value
    assert {k: v for k, v in last.items() if v is not None} == counters
    plain = df.where("op != 3")
    for retain in (100, 399):
        small = maintenance.compacted(plain, retain)
        assert {r.key: r.seq for r in visibility.visible(small).collect()} == {r.key: r.seq for r in visibility.visible(plain).collect()}
        assert {r.key: r.seq for r in visibility.visible(small, retain).collect()} == {r.key: r.seq for r in visibility.visible(plain, retain).collect()}
