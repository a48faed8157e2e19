"""Reads of the live set and of the raw log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import prefix_end
from .visibility import visible


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def get(log: DataFrame, key, cf_id: int = 1, seq: int | None = None) -> DataFrame:
    """The value of one key, no row if it is absent. Only ops on the key and ranges over it are read."""
    k = F.lit(key)
    own = log.where((F.col("cf_id") == cf_id) & ((F.col("key") == k) | ((F.col("op") == 2) & (F.col("key") <= k) & (k < F.col("end_key")))))
    return visible(own, seq).where(F.col("key") == k)


def multi_get(log: DataFrame, keys: list, cf_id: int = 1, seq: int | None = None) -> DataFrame:
    """One row per asked key, in its place: place, key, value (null on a miss). Duplicates are kept; a null key is an error."""
    if any(k is None for k in keys):
        raise ValueError("a key is null")
    spark = log.sparkSession
    kind = log.schema["key"].dataType.simpleString()
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"place long, key {kind}")
    points = log.where((F.col("cf_id") == cf_id) & (F.col("op") != 2)).join(F.broadcast(asked.select("key").distinct()), "key", "left_semi")
    live = visible(points.unionByName(log.where((F.col("cf_id") == cf_id) & (F.col("op") == 2))), seq)
    return asked.join(live.select("key", "value"), "key", "left").select("place", "key", "value").orderBy("place")


def bounded(log: DataFrame, low=None, high=None, closed: bool = False) -> DataFrame:
    """The ops that decide what is live in [low, high) (with closed: [low, high]): ops on keys inside, and range deletes that meet it. The bounds reach the scan of the log."""
    is_range = F.col("op") == 2
    if low is not None:
        log = log.where(F.when(is_range, F.col("end_key") > _lit(low)).otherwise(F.col("key") >= _lit(low)))
    if high is not None:
        log = log.where(F.col("key") <= _lit(high) if closed else F.col("key") < _lit(high))
    return log


def scan(log: DataFrame, cf_id: int = 1, seq: int | None = None, low=None, high=None, prefix: bytes | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Live rows in key order: of [low, high), of a prefix, backwards, or the first `limit`."""
    if isinstance(prefix, str):
        low = prefix if low is None else max(low, prefix)
    elif prefix is not None:
        end = prefix_end(prefix)
        low = bytearray(prefix if low is None else max(bytes(low), prefix))
        high = high if end is None else bytearray(end if high is None else min(bytes(high), end))
    live = visible(bounded(log.where(F.col("cf_id") == cf_id), low, high), seq)
    if isinstance(prefix, str):
        live = live.where(F.col("key").startswith(prefix))
    rows = live.orderBy(F.col("key").desc() if reverse else F.col("key"))
    return rows if limit is None else rows.limit(limit)


def seek(log: DataFrame, target, cf_id: int = 1, seq: int | None = None) -> DataFrame:
    """The first live row at or above target."""
    return scan(log, cf_id, seq, low=target, limit=1)


def seek_for_prev(log: DataFrame, target, cf_id: int = 1, seq: int | None = None) -> DataFrame:
    """The last live row at or below target."""
    return visible(bounded(log.where(F.col("cf_id") == cf_id), high=target, closed=True), seq).orderBy(F.col("key").desc()).limit(1)


def limited_scan(log: DataFrame, limit: int = 100, cf_id: int = 1) -> tuple[DataFrame, bool]:
    """The first `limit` live rows as base64, and whether there are more."""
    more = scan(log, cf_id, limit=limit + 1)
    rows = more.limit(limit).select(F.base64("key").alias("key"), F.base64("value").alias("value"))
    return rows, more.count() > limit


def first_last(log: DataFrame, seq: int | None = None) -> DataFrame:
    return visible(log, seq).groupBy("cf_id").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("live_keys"))


def raw(log: DataFrame, cf_id: int | None = None) -> DataFrame:
    """All versions and tombstones, by key and newest first."""
    return (log if cf_id is None else log.where(F.col("cf_id") == cf_id)).orderBy("cf_id", "key", F.col("seq").desc())


def history(log: DataFrame, key, cf_id: int = 1) -> DataFrame:
    """All ops on one key, newest first."""
    return log.where((F.col("cf_id") == cf_id) & (F.col("key") == F.lit(key)) & (F.col("op") != 2)).orderBy(F.col("seq").desc())


def snapshot_diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """Keys whose value differs between two sequence numbers: cf_id, key, old_value, new_value, change."""
    old, new = (visible(log, s).select("cf_id", "key", F.col("seq").alias(f"{n}_seq"), F.col("value").alias(f"{n}_value")) for s, n in ((before, "old"), (after, "new")))
    change = F.when(F.col("old_seq").isNull(), "added").when(F.col("new_seq").isNull(), "removed").otherwise("changed")
    return old.join(new, ["cf_id", "key"], "full").where(~F.col("old_seq").eqNullSafe(F.col("new_seq"))).select("cf_id", "key", "old_value", "new_value", change.alias("change"))
