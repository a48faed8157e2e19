"""Report rules and value checks against cases worked out by hand, and range deletes of any nesting against brute force."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import maintenance, ranks, reads, reports, visibility
from tidemark.sources import oplog


def measured(spark, spans):
    rows = [("a", i, s) for i, s in enumerate(spans)]
    df = spark.createDataFrame(rows, "k string, t long, span long")
    return sorted(r.t for r in reports.steady(df, "k", "t", "span").collect())


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([9], [0]),  # nothing to warm up
        ([9, 9], [1]),
        ([9, 9, 1], [2]),  # no sample between warm-up and last: the last one stays
        ([9, 9, 9, 1], [2]),  # it took under half of the median
        ([9, 9, 9, 5], [2, 3]),
        ([1, 1, 4, 10, 4], [2, 3]),  # upper median of 4 and 10 is 10
        ([1, 1, 0, 0, 0], [2, 3, 4]),  # a median of 0 drops nothing
    ],
)
def test_steady(spark, spans, want):
    assert measured(spark, spans) == want


def test_rates(spark):
    df = spark.createDataFrame([("a", 1000, 10), ("a", 3000, 14), ("a", 3000 + 500, 2), ("a", 4000, 12), ("b", 5, 1)], "k string, t long, n long")
    assert sorted((r.t, r.rate) for r in reports.rates(df, "k", "t", "n").collect()) == [(3000, 2.0), (3500, 0.0), (4000, 20.0)]
    same = spark.createDataFrame([("a", 7, 1), ("a", 7, 1)], "k string, t long, n long")
    assert [r.rate for r in reports.rates(same, "k", "t", "n").collect()] == [0.0]
    two = reports.rates(df.withColumn("m", F.lit(3)), "k", "t", "n", "m").where("t = 3000").head()
    assert (two.n_rate, two.m_rate) == (2.0, 0.0)


def test_faults(spark):
    df = spark.createDataFrame([("x", s) for s in ["RECOVERED", "DETECTED", "DETECTED_BY_VERIFY", "UNEXPECTED_OPEN", "UNEXPECTED", "recovered", "SKIPPED"]], "kind string, status string")
    assert tuple(reports.fault_counts(df).head()) == ("x", 7, 1, 2, 2)
    assert {r.status: r.n for r in reports.status_counts(df).collect()}["DETECTED_BY_VERIFY"] == 1


def test_summary(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 1, 1, 9]] + [("b", None), (None, 3.0)], "k string, v double")
    got = {r.k: r for r in reports.summary(df, "k", "v").collect()}
    assert (got["a"].n, got["a"].avg, got["a"].p05, got["a"].p50, got["a"].p95, got["a"].drop) == (4, 4.0, 1.0, 1.0, 9.0, 0.0)
    assert (got["b"].n, got["b"].p50, got["b"].drop) == (1, 0.0, 0.0) and got[None].p95 == 3.0


def test_values(spark):
    row = spark.range(1).select(codec.described_value(F.lit(77), F.lit(5), F.lit(40), 9).alias("v"), codec.described_value(F.lit(1), F.lit(2), F.lit(3), 9).alias("least")).head()
    lead = (0x4C524E31).to_bytes(4, "big") + (77).to_bytes(8, "big") + (5).to_bytes(8, "big") + (40).to_bytes(4, "big")
    body = bytes((9 + 77 * 31 + 5 * 17 + i) & 255 for i in range(28, 40))
    assert bytes(row.v) == lead + zlib.crc32(lead + body).to_bytes(4, "big") + body and len(row.least) == 28
    good = bytes(row.v)
    rows = [(good, 77, 5), (None, 77, 5), (good[:20], 77, 5), (good[:-1] + b"x", 77, 5), (good, 77, 6), (good + b"y", 77, 5)]
    df = spark.createDataFrame([(bytearray(v) if v is not None else None, k, s) for v, k, s in rows], "v binary, k long, s long")
    assert [r.p for r in df.select(codec.value_problem(F.col("v"), F.col("k"), F.col("s")).alias("p")).collect()] == [None, "missing value", "value too small", "checksum mismatch", "value mismatch", "checksum mismatch"]


def test_fragments(spark):
    rng = random.Random(5)
    ranges = [(1, a, a + rng.randrange(1, 60), i) for i, a in enumerate(rng.randrange(200) for _ in range(150))] + [(1, i, 400 - i, 1000 - i) for i in range(150)] + [(2, 5, 6, 1)]
    tombs = spark.createDataFrame(ranges, "cf_id int, begin long, end long, range_seq long")
    at = sorted((r.cf_id, r.at, r.range_seq) for r in visibility.fragments(tombs).collect())
    for c, k, seq in at:
        assert seq == max((s for f, a, b, s in ranges if f == c and a <= k < b), default=None)
    points = spark.createDataFrame([(c, k) for c in (1, 2, 3) for k in range(0, 420, 7)], "cf_id int, key long")
    for strategy in ("broadcast", "sweep"):
        for r in visibility.newest_cover(points, tombs, strategy).collect():
            assert r.cover == max((s for f, a, b, s in ranges if f == r.cf_id and a <= r.key < b), default=None)


def test_places(spark):
    rows = [(i % 3 if i % 2 else 0, i) for i in range(500)]
    got = ranks.placed(spark.createDataFrame(rows, "a long, b long"), ["a", "b"]).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)] == sorted(rows) and sorted(r.place for r in got) == list(range(500))
    ops = spark.createDataFrame([(7, i) for i in range(300)] + [(3, 0)], "batch_id long, op_index long")
    numbered = {(r.batch_id, r.op_index): r.seq for r in oplog.numbered(ops, 10).collect()}
    assert numbered[3, 0] == 11 and all(numbered[7, i] == 12 + i for i in range(300))


def test_bounded_scans(spark):
    log = spark.createDataFrame([(1, 1, 1, 5, None, 50, None), (1, 2, 1, 9, None, 90, None), (1, 3, 2, 1, 6, None, None), (1, 4, 1, 3, None, 30, None), (1, 5, 2, 8, 20, None, None)], "cf_id int, seq long, op int, key long, end_key long, value long, delta long")
    assert [r.key for r in reads.scan(log, low=4, high=10).collect()] == [] and [r.key for r in reads.scan(log, low=2, high=4).collect()] == [3]
    assert [r.key for r in reads.seek_for_prev(log, 9).collect()] == [3] and [r.key for r in reads.scan(log, seq=2, low=5, high=9).collect()] == [5]
    back = oplog.ordered_by(log, lambda k: -k)
    assert [r.key.key for r in reads.scan(back.where("op = 1")).collect()] == [9, 5, 3]


def test_sizes(spark):
    log = spark.createDataFrame([(1, 1, 1, 5, 50), (1, 2, 1, 12, None), (2, 3, 1, 5, 7)], "cf_id int, seq long, op int, key long, value long")
    assert [tuple(r) for r in maintenance.range_sizes(log, [(0, 100), (6, 13), (7, 7)]).collect()] == [(0, 5, 2), (1, 2, 1), (2, 0, 0)]
    files = spark.createDataFrame([("CURRENT", 1), ("000007.sst", 2), ("000008.sst", 3), ("LOG.old", 4), ("x.txt", 5)], "name string, size long")
    assert {r.type: (r.files, r.bytes) for r in maintenance.file_types(files).collect()} == {"current": (1, 1), "table": (2, 5), "info_log": (1, 4)}
