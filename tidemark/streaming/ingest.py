"""Streams of batches into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Commits each micro-batch of ops (OP_LOG columns but seq) as one commit. A micro-batch that is replayed is passed over: its number is kept in batch_id above bit 40."""

    def commit(batch: DataFrame, number: int) -> None:
        low = number << 40
        if store.log().where((F.col("batch_id") >= low) & (F.col("batch_id") < low + (1 << 40))).isEmpty():
            store.write(batch.withColumn("batch_id", F.col("batch_id") + F.lit(low)))

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
