"""What is visible at a sequence number: latest wins, deletes, range deletes, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import ADD, DELETE, DELETE_RANGE, PUT, wrapped, wrapping_sum
from .ranks import checkpointed, dealt, placed

#: Range deletes that are broadcast at most, for every key is held against each of them; beyond it keys and ranges are swept together in order.
BROADCAST_RANGES = 1000
#: Places of a block when runs of keys are dealt out, as a power of two.
BLOCK_BITS = 12
#: The runs of places [lo, hi) as blocks of 2^level places, at most two a level, as a binary tree over all places has them.
BLOCKS_SQL = """explode(filter(flatten(transform(sequence(0, CAST(floor(log2(hi - lo)) AS INT) + 1), l -> array(
  CASE WHEN shiftright(lo + shiftleft(1L, l) - 1, l) < shiftright(hi, l) AND shiftright(lo + shiftleft(1L, l) - 1, l) % 2 = 1 THEN struct(l AS level, shiftright(lo + shiftleft(1L, l) - 1, l) AS block) END,
  CASE WHEN shiftright(lo + shiftleft(1L, l) - 1, l) < shiftright(hi, l) AND shiftright(hi, l) % 2 = 1 THEN struct(l AS level, shiftright(hi, l) - 1 AS block) END))), b -> b IS NOT NULL)) AS b"""


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    return log if seq is None else log.where(F.col("seq") <= seq)


def latest(log: DataFrame, ops: tuple[int, ...] = (DELETE, PUT)) -> DataFrame:
    """The newest of `ops` for each key: cf_id, key, seq, op, value. A hash aggregate with partial sums, no sort."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("w")
    return log.where(F.col("op").isin(*ops)).groupBy("cf_id", "key").agg(newest).select("cf_id", "key", "w.seq", "w.op", "w.value")


def ranges(log: DataFrame) -> DataFrame:
    """Range deletes, the newest of each (begin, end)."""
    return log.where(F.col("op") == DELETE_RANGE).groupBy("cf_id", F.col("key").alias("begin"), F.col("end_key").alias("end")).agg(F.max("seq").alias("range_seq"))


def fragments(tombs: DataFrame) -> DataFrame:
    """Disjoint pieces of overlapping ranges with the newest sequence number that covers each: cf_id, at, range_seq (null where nothing covers any more).

    Bounds get a place in order; a range is a run of places, cut into blocks of powers of two, and a piece takes the newest of the blocks that hold it. So n ranges give
    some n log n rows however they nest.
    """
    bounds = placed(tombs.select("cf_id", F.explode(F.array("begin", "end")).alias("at")).distinct(), ["cf_id", "at"])
    bounds = checkpointed(bounds)
    first, last = bounds.select("cf_id", F.col("at").alias("begin"), F.col("place").alias("lo")), bounds.select("cf_id", F.col("at").alias("end"), F.col("place").alias("hi"))
    blocks = tombs.join(first, ["cf_id", "begin"]).join(last, ["cf_id", "end"]).select("range_seq", F.expr(BLOCKS_SQL)).select("b.*", "range_seq")
    strongest = blocks.groupBy("level", "block").agg(F.max("range_seq").alias("range_seq"))
    top = max(1, bounds.count()).bit_length()
    above = bounds.select("place", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")).withColumn("block", F.expr("shiftright(place, level)"))
    newest = above.join(strongest, ["level", "block"]).groupBy("place").agg(F.max("range_seq").alias("range_seq"))
    return bounds.join(newest, "place", "left").select("cf_id", "at", "range_seq")


def newest_cover(points: DataFrame, tombs: DataFrame, strategy: str = "auto") -> DataFrame:
    """Adds cover, the newest range delete over each point's key (null if none).

    broadcast: a nested-loop join with at most BROADCAST_RANGES ranges. sweep: points and fragments sorted together, family by family and range by range of keys, each point
    taking the last fragment before it; a family's rows spread over key buckets, which start from the last fragment before them.
    """
    if strategy == "auto":
        strategy = "broadcast" if tombs.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES else "sweep"
    if strategy == "broadcast":
        t = F.broadcast(tombs.withColumnRenamed("cf_id", "t_cf"))
        hit = points.select("cf_id", "key").distinct().join(t, (F.col("cf_id") == F.col("t_cf")) & (F.col("begin") <= F.col("key")) & (F.col("key") < F.col("end")))
        covers = hit.groupBy("cf_id", "key").agg(F.max("range_seq").alias("cover"))
        return points.join(covers, ["cf_id", "key"], "left")
    marks = fragments(tombs).select("cf_id", F.col("at").alias("key"), F.struct(F.lit(True).alias("set"), "range_seq").alias("mark"))
    both = points.withColumn("is_point", F.lit(1)).unionByName(marks.withColumn("is_point", F.lit(0)), allowMissingColumns=True)
    order = ["cf_id", "key", "is_point"]
    rows = dealt(both, order)
    carry = rows.groupBy("_part").agg(F.max_by(F.struct("cf_id", "mark"), F.when(F.col("is_point") == 0, F.struct("cf_id", "key"))).alias("last"))
    carry = carry.select("_part", F.last("last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"))
    swept = rows.withColumn("m", F.last("mark", ignorenulls=True).over(Window.partitionBy("_part", "cf_id").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.where("is_point = 1").join(F.broadcast(carry), "_part", "left")
    cover = F.when(F.col("m").isNotNull(), F.col("m.range_seq")).when(F.col("from_before.cf_id") == F.col("cf_id"), F.col("from_before.mark.range_seq"))
    return swept.select(*points.columns, cover.alias("cover"))


def covered(keys: DataFrame, tombs: DataFrame) -> DataFrame:
    """Every key with each range delete over it: cf_id, key, seq, for distinct keys (cf_id, key) of any ordered type and tombs (cf_id, begin, end, seq).

    Keys get places in order, a bound the place of the first key at or above it, in two levels: range partitions, then rows. A range is a run of places, so the join
    is by place and forms no pair that is not in the result. Runs are dealt out in blocks first, so that no array grows with a range.
    """
    bounds = tombs.select("cf_id", F.explode(F.array("begin", "end")).alias("key")).distinct()
    both = bounds.withColumn("is_key", F.lit(0)).unionByName(keys.withColumn("is_key", F.lit(1)))
    places = checkpointed(placed(both, ["cf_id", "key", "is_key"], weight=F.col("is_key")))
    at = lambda bound, name: places.where("is_key = 0").select("cf_id", F.col("key").alias(bound), F.col("place").alias(name))
    runs = tombs.join(at("begin", "lo"), ["cf_id", "begin"]).join(at("end", "hi"), ["cf_id", "end"]).where("lo < hi").select("seq", "lo", "hi")
    blocks = runs.select("*", F.explode(F.sequence(F.shiftright("lo", BLOCK_BITS), F.shiftright(F.col("hi") - 1, BLOCK_BITS))).alias("block"))
    first, last = F.greatest("lo", F.shiftleft("block", BLOCK_BITS)), F.least("hi", F.shiftleft(F.col("block") + 1, BLOCK_BITS)) - 1
    return blocks.select("seq", F.explode(F.sequence(first, last)).alias("place")).join(places.where("is_key = 1").drop("is_key"), "place").select("cf_id", "key", "seq")


def visible(log: DataFrame, seq: int | None = None, strategy: str = "auto") -> DataFrame:
    """Live puts at `seq` (the newest if None): cf_id, key, seq, value. A key is absent if its newest op is a delete or a newer range delete covers it; an empty value is a value."""
    bounded = as_of(log, seq)
    puts = latest(bounded).where(F.col("op") == PUT)
    return newest_cover(puts, ranges(bounded), strategy).where("cover IS NULL OR cover < seq").select("cf_id", "key", "seq", "value")


def counters(log: DataFrame, seq: int | None = None, strategy: str = "auto") -> DataFrame:
    """Counter values at `seq`: the value of the newest reset (put, delete or covering range delete) and all adds after it, wrapping like 64-bit numbers.

    cf_id, key, value; present if the newest reset is a put or an add follows it. Values must be numbers here; BINARY values are decoded by from_little_endian first.
    """
    bounded = as_of(log, seq)
    keys = bounded.where(F.col("op") != DELETE_RANGE).select("cf_id", "key").distinct()
    resets = newest_cover(keys, ranges(bounded), strategy).join(latest(bounded).select("cf_id", "key", F.col("seq").alias("point"), "op", "value"), ["cf_id", "key"], "left")
    put = (F.col("op") == PUT) & (F.coalesce("cover", F.lit(-1)) < F.col("point"))
    resets = resets.select("cf_id", "key", F.greatest(F.coalesce("point", F.lit(-1)), F.coalesce("cover", F.lit(-1))).alias("base"), F.coalesce(put, F.lit(False)).alias("has"), F.when(put, F.col("value")).otherwise(0).alias("start"))
    adds = bounded.where(F.col("op") == ADD).select("cf_id", "key", F.col("seq").alias("at"), "delta")
    after = resets.join(adds, ["cf_id", "key"], "left").groupBy("cf_id", "key", "has", "start").agg(F.sum(F.when(F.col("at") > F.col("base"), F.col("delta").cast("decimal(20,0)"))).alias("added"))
    total = wrapped((F.col("start").cast("decimal(20,0)") + F.coalesce("added", F.lit(0).cast("decimal(30,0)"))).cast("decimal(38,0)"))
    return after.where("has OR added IS NOT NULL").select("cf_id", "key", total.alias("value"))


def counter_history(log: DataFrame, strategy: str = "auto") -> DataFrame:
    """The counter's value after each op on its key: cf_id, key, seq, value (null where absent). Range deletes reset the keys that have ops.

    Each key's ops and the range deletes over it are put in order; a reset begins a segment, within which adds are summed. A range delete meets only keys that it covers.
    """
    points = log.where(F.col("op") != DELETE_RANGE).select("cf_id", "key", "seq", "op", F.coalesce("value", "delta").alias("v"))
    keys = points.select("cf_id", "key").distinct()
    tombs = log.where(F.col("op") == DELETE_RANGE).select("cf_id", F.col("key").alias("begin"), F.col("end_key").alias("end"), "seq")
    resets = covered(keys, tombs).select("cf_id", "key", "seq", F.lit(DELETE).alias("op"), F.lit(None).cast("long").alias("v"))
    order = Window.partitionBy("cf_id", "key").orderBy("seq")
    ops = points.unionByName(resets).withColumn("segment", F.sum(F.when(F.col("op") != ADD, 1).otherwise(0)).over(order))
    inside = Window.partitionBy("cf_id", "key", "segment").orderBy("seq")
    some = F.max(F.when(F.col("op") != DELETE, 1).otherwise(0)).over(inside)
    return ops.select("cf_id", "key", "seq", F.when(some == 1, wrapping_sum_over(inside)).alias("value"))


def add_results(log: DataFrame) -> DataFrame:
    """What each add returns, the counter's value right after it: cf_id, key, seq, value."""
    adds = log.where(F.col("op") == ADD).select("cf_id", "key", "seq")
    return counter_history(log).join(adds, ["cf_id", "key", "seq"], "left_semi")


def wrapping_sum_over(window) -> F.Column:
    return wrapped(F.sum(F.coalesce("v", F.lit(0)).cast("decimal(20,0)")).over(window).cast("decimal(38,0)"))


__all__ = ["add_results", "as_of", "counter_history", "counters", "covered", "fragments", "latest", "newest_cover", "ranges", "visible", "wrapping_sum"]
