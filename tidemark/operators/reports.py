"""Run reports: rates, percentiles, histograms, operation statistics, faults, reclamation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram's buckets, in microseconds (fixed values); the last bucket is open.
BUCKETS = (10, 100, 1000, 10000)


def rates(samples: DataFrame, key: str, time: str, *counters: str) -> DataFrame:
    """Increase of cumulative counters over the time since the sample before it, per second: key, time, and a column rate (of one counter) or <counter>_rate for each.

    A counter that falls (a restart) counts as unchanged, and less than a millisecond as one. The first sample of a key has none before it and gives no row.
    """
    order = Window.partitionBy(key).orderBy(time)
    gone = F.greatest(F.col(time) - F.lag(time).over(order), F.lit(1))
    names = ["rate"] if len(counters) == 1 else [f"{c}_rate" for c in counters]
    grown = [(F.greatest(F.col(c) - F.lag(c).over(order), F.lit(0)) * 1000.0 / gone).alias(n) for c, n in zip(counters, names, strict=True)]
    return samples.select(key, time, *grown, F.lag(time).over(order).alias("_before")).where("_before IS NOT NULL").drop("_before")


def counted(values: DataFrame, key: str, column: str) -> DataFrame:
    """Each key's values once, in order: key, value, n (rows of the key), upto (rows of the key up to the value). Rows are summed by value before any window, so what is sorted is distinct values."""
    counts = values.where(F.col(column).isNotNull()).groupBy(key, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("times"))
    along, everything = Window.partitionBy(key).orderBy("value"), Window.partitionBy(key)
    return counts.select(key, "value", F.sum("times").over(everything).alias("n"), F.sum("times").over(along).alias("upto"))


def summary(values: DataFrame, key: str, column: str) -> DataFrame:
    """n, avg, min, max, p05, p50, p95 (nearest rank: the value at place ceil(p n) in order, 0 for none) and the throughput drop 1 - p05 / p50 of each key."""
    percentiles = [F.coalesce(F.min(F.when(F.col("upto") >= F.ceil(F.col("n") * F.lit(p)), F.col("value"))), F.lit(0.0)).alias(name) for name, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))]
    ranks = counted(values, key, column).groupBy(F.col(key).alias("_key")).agg(*percentiles)
    out = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("avg"), F.min(column).alias("min"), F.max(column).alias("max"))
    out = out.join(ranks, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key").fillna(0.0, ["p05", "p50", "p95"])
    return out.withColumn("drop", F.when(F.col("p50") > 0, F.greatest(F.lit(0.0), 1 - F.col("p05") / F.col("p50"))).otherwise(0.0))


def steady(samples: DataFrame, key: str, time: str, span: str, warm_up: int = 2) -> DataFrame:
    """Samples that are measured: without the first `warm_up` (all but one where there are no more), and without a last one that took under half the median span.

    The median is the upper one of the samples between warm-up and last; where there are none, nothing goes at the end.
    """
    numbered = samples.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(time))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    numbered = numbered.withColumn("warm", F.when(F.col("n") > warm_up, warm_up).otherwise(F.col("n") - 1))
    middle = counted(numbered.where((F.col("i") > F.col("warm")) & (F.col("i") < F.col("n"))), key, span)
    middle = middle.groupBy(F.col(key).alias("_key")).agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("value"))).alias("middle"))
    short = (F.col("i") == F.col("n")) & (F.col("middle") > 0) & (F.col(span) * 2 < F.col("middle"))
    kept = numbered.where(F.col("i") > F.col("warm")).join(middle, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    return kept.where(~F.coalesce(short, F.lit(False))).drop("i", "n", "warm", "middle")


def histogram(values: DataFrame, key: str, column: str) -> DataFrame:
    bucket = F.lit(f">{BUCKETS[-1]}")
    for b in reversed(BUCKETS):
        bucket = F.when(F.col(column) <= b, f"<={b}").otherwise(bucket)
    return values.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def operation_stats(values: DataFrame, key: str, column: str, slow: float) -> DataFrame:
    return values.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("total"), F.avg(column).alias("avg"), F.max(column).alias("max"), F.count_if(F.col(column) >= slow).alias("slow"))


def fault_counts(faults: DataFrame, key: str = "kind", status: str = "status") -> DataFrame:
    """Faults of each kind by outcome: n, recovered, detected (at once or by a later verification), unexpected (any status that begins so)."""
    of = F.col(status)
    return faults.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(of == "RECOVERED").alias("recovered"), F.count_if(of.isin("DETECTED", "DETECTED_BY_VERIFY")).alias("detected"), F.count_if(of.startswith("UNEXPECTED")).alias("unexpected"))


def status_counts(faults: DataFrame, status: str = "status") -> DataFrame:
    return faults.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def reclamation(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "backoff").alias("backoff"), F.coalesce(F.sum("shrink_bytes"), F.lit(0)).cast("long").alias("shrink_bytes"))


def amplification(physical: Column, live: Column) -> Column:
    """Physical over live bytes; over 5.0 a run fails."""
    return F.when(live > 0, physical / live).otherwise(0.0)
