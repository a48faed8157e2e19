"""Op logs: the canonical schema, the log in `events`, and logs made of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, StructField, StructType

from ..functions.codec import ADD, DELETE_RANGE
from ..operators.ranks import placed

OP_LOG = StructType([
    StructField("cf_id", IntegerType()), StructField("seq", LongType()), StructField("op", ByteType()), StructField("key", BinaryType()), StructField("end_key", BinaryType()),
    StructField("value", BinaryType()), StructField("delta", LongType()), StructField("batch_id", LongType()), StructField("op_index", IntegerType()),
])

#: The op log in `events`, with whole-number keys: the same text for Spark and for the SQL that checks it. floor() before the cast, for engines cast halves differently.
EVENT_COLUMNS = {
    "cf_id": "CAST(event_id % 3 AS INT) + 1",
    "seq": "event_id",
    "op": "CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 0 WHEN 'purchase' THEN 2 ELSE 1 END",
    "key": "user_id",
    "end_key": "CASE WHEN event_type = 'purchase' THEN user_id + CAST(floor(value) AS BIGINT) % 5 + 1 END",
    "value": "CASE WHEN event_type NOT IN ('click', 'error', 'purchase') THEN CAST(floor(value * 100) AS BIGINT) END",
    "delta": "CASE WHEN event_type = 'click' THEN CAST(floor(value * 100) AS BIGINT) END",
}


def event_log(events: DataFrame, families: bool = False) -> DataFrame:
    """`events` as an op log; all in family 1 unless `families`."""
    columns = EVENT_COLUMNS | ({} if families else {"cf_id": "1"})
    return events.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def ordered_by(log: DataFrame, order: Callable[[Column], Column]) -> DataFrame:
    """The log in a custom key order: keys and range ends become (order(key), key), which every read compares part by part, so that scans, bounds and range deletes follow `order`."""
    own = lambda c: F.when(F.col(c).isNotNull(), F.struct(order(F.col(c)).alias("sort_key"), F.col(c).alias("key")))
    return log.withColumn("key", own("key")).withColumn("end_key", own("end_key"))


def validated(ops: DataFrame) -> DataFrame:
    """Fails on ops that the log must not take: a range whose end is not above its begin, an add without a delta, a missing key."""
    wrong = (
        F.when(F.col("key").isNull(), "a key is null")
        .when((F.col("op") == DELETE_RANGE) & (F.col("end_key").isNull() | (F.col("key") >= F.col("end_key"))), "a range must end above its begin")
        .when((F.col("op") == ADD) & F.col("delta").isNull(), "an add needs a delta")
        .when((F.col("op") == 1) & F.col("value").isNull(), "a put needs a value")
        .when(~F.col("op").isin(0, 1, 2, 3), "an unknown op")
    )
    return ops.withColumn("key", F.when(wrong.isNull(), F.col("key")).otherwise(F.raise_error(wrong).cast(ops.schema["key"].dataType)))


def numbered(batches: DataFrame, last_seq: int = 0) -> DataFrame:
    """Gives the ops of batches (batch_id, op_index) consecutive sequence numbers after `last_seq`, in batch order. Ops are placed in range partitions, so a batch of any size spreads over tasks."""
    return placed(batches, ["batch_id", "op_index"]).withColumn("seq", F.lit(last_seq + 1) + F.col("place")).drop("place")
