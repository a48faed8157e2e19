import pytest
from pyspark.sql import functions as F

from tests.test_visibility import ADD, DEL, PUT, RDEL, log
from tidemark.operators import visibility
from tidemark.sources.store import Plugin, Store, StoreError
from tidemark.streaming.ingest import ingest


def ops(spark, *rows):
    return log(spark, rows).drop("seq")


def values(df):
    return {bytes(r.key): bytes(r.value) for r in df.collect()}


def test_store_life(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    assert store.write(ops(spark, (PUT, b"a", b"1"), (PUT, b"b", b"2"))) == 2
    snapshot = store.snapshot()
    store.write(ops(spark, (PUT, b"a", b"3"), (DEL, b"b", b""), (PUT, b"c", b"4"), (RDEL, b"c", b"d")))
    assert store.write(spark.createDataFrame([], store.log().drop("seq").schema)) == 6
    assert values(store.live()) == {b"a": b"3"} and values(store.live(snapshot)) == {b"a": b"1", b"b": b"2"}
    assert store.compact(retain_seq=snapshot) and values(store.live(snapshot)) == {b"a": b"1", b"b": b"2"}
    store.compact()
    again = Store(spark, f"file://{tmp_path}/db", create=False, read_only=True)
    assert values(again.live()) == {b"a": b"3"} and again.check() == [] and again.properties()["runs"] == "1"
    with pytest.raises(StoreError):
        again.write(ops(spark, (PUT, b"x", b"1")))
    meta = store.create_family("meta")
    store.write(ops(spark, (ADD, b"n", 10, meta), (ADD, b"n", -3, meta)))
    assert [r.value for r in visibility.counters(store.log().where(F.col("cf_id") == meta).withColumn("value", F.lit(None).cast("long"))).collect()] == [7]
    store.rename_family(meta, "other")
    store.drop_family(meta)
    assert store.create_family("meta") == meta + 1
    with pytest.raises(StoreError):
        store.drop_family(1)
    assert store.checkpoint(f"file://{tmp_path}/copy") == store.log().count()
    with pytest.raises(StoreError):
        store.checkpoint(f"file://{tmp_path}/copy")


def test_plugins(spark, tmp_path):
    def refuse(df):
        raise StoreError("no")

    seen = []
    store = Store(spark, f"file://{tmp_path}/db", plugins=[Plugin("soft", before=refuse, after=seen.append, fail_fast=False)])
    assert store.write(ops(spark, (PUT, b"a", b"1"))) == 1 and seen == [1]
    store.plugins = [Plugin("hard", before=refuse)]
    with pytest.raises(StoreError):
        store.write(ops(spark, (PUT, b"b", b"1")))
    assert store.snapshot() == 1


def test_stream(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    batch = ops(spark, (PUT, b"a", b"1"), (PUT, b"b", b"2"))
    batch.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/cp").awaitTermination(60)
    assert values(store.live()) == {b"a": b"1", b"b": b"2"} and store.snapshot() == 2


def test_two_writers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/db")
    state = store.state()
    store.write(ops(spark, (PUT, b"a", b"1")))
    late = Store(spark, f"file://{tmp_path}/db")
    late.state = lambda: state  # read before the other's commit
    with pytest.raises(StoreError):
        late.write(ops(spark, (PUT, b"b", b"2")))
    assert values(store.live()) == {b"a": b"1"}
