"""Places in a global order, in two levels: range partitions, then rows. No key, however hot, is numbered by one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder of spark.checkpoint.dir. Where that is unset, a local master takes a folder of its own; a cluster, whose executors share none, is refused."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    """df in range partitions of `order`, each row with its partition's number, _part. Range bounds are sampled, so the rows dealt are written: a later run of the same plan might deal them otherwise."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def placed(df: DataFrame, order: list[str], name: str = "place", weight: Column | None = None) -> DataFrame:
    """Adds the sum of `weight` (1 for each row) over all rows before this one in `order`; rows that tie on all of it are put in any order. The broadcast has one row a shuffle partition."""
    rows = dealt(df, order)
    each = F.lit(1) if weight is None else weight
    before = rows.groupBy("_part").agg(F.sum(each).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_outside"))
    inside = F.sum(each).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - each
    return rows.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_inside") + F.col("_outside")).drop("_part", "_inside", "_outside")
