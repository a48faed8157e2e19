"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Mantissa bits taken from the hash of a document's number.
HEX_DIGITS = 13


def targets(sources: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """Adds target to (source, source_size, ...): sources by code point (null last) weigh `weights`, repeating,
    and share `share` times the sum of all sizes; none gets more than `cap` times its own size, and what is over goes to the
    others by weight until none is above. One row per source passes through one window, never a document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("full_at", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(everything)["level"])
    full = F.lit(float(cap)) * F.col("source_size")
    return ranked.select("source", "source_size", "n_docs", F.coalesce(F.least(full, F.col("weight") * F.col("level")), full).alias("target"))


def levels(classes: DataFrame, cap: float) -> DataFrame:
    """For classes (source, weight, size, target) of documents: source and level, so that documents expected least(cap, level * weight) times make up the target.

    Classes are taken as capped from the heaviest on until none below would be above the cap. level is null where all are capped. Weights are whole numbers, so the sums are exact.
    """
    heavier = Window.partitionBy("source").orderBy(F.desc("weight"))
    above = F.coalesce(F.sum("size").over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("weight") * F.col("size")).over(heavier.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(onward > 0, (F.col("target") - F.lit(float(cap)) * above) / onward)
    ranked = classes.withColumn("level", level)
    return ranked.groupBy("source").agg(F.max_by("level", F.when(F.col("weight") * F.col("level") <= cap, F.col("weight"))).alias("level"))


def mix(documents: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, seed: int = 17, weight_col: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Says how often each document is taken, so that every source's words come near its target.

    A document's expected copies are in proportion to its weight within its source, at most `cap`; what is over goes to the source's other documents by weight.
    Weights are whole numbers: `weight_col`, or the number of binary digits of the document's size, so that longer documents are likelier. null or below 1 counts as 0: never taken
    unless all others are capped and words are left, which then stay untaken.
    The whole part of the copies is certain. The rest is the inclusion probability p: with u from a hash of number and text, documents of a source are ranked by
    (u / (1 - u)) / (p / (1 - p)), Pareto order sampling, and taken once more in that order until the words wanted are reached
    (the document in whose middle the target lies decides by its middle). Reruns agree.

    Returns doc_id, source, size, source_size, target, expected, whole, copies, taken and the columns named in `carry` for every row.
    Null or empty text: size 0, taken 0, and never drawn. Null source: a source of its own, last. Null doc_id: hashed as 'null'. Repeated rows: sampled as rows of one hash, in order of size.
    A source of words none: target 0. Empty table: no rows. Other columns are not read; those carried must not have the names above.

    A source may hold any share of all rows: it is cut by rank into about sqrt(rows) cells that are pre-aggregated; only the one cell
    in which the target lies is ranked row by row. Weights are pre-aggregated, too: one row for each source and weight passes through a window, and no document.
    """
    carry = carry or []
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    u = (F.conv(F.substring(F.md5(seeded.cast("binary")), 1, HEX_DIGITS), 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
    base = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), u.alias("u"), *([F.col(weight_col).cast("long").alias("weight")] if weight_col else []), *carry)
    own = F.when(F.col("weight") >= 1, F.col("weight")).otherwise(0) if weight_col else F.length(F.bin("size"))
    base = stored(base.withColumn("weight", own.cast("long")), "mix-sizes")
    classes = stored(base.groupBy("source", "weight").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "mix-weights")
    sums = classes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_docs"))
    wanted = stored(targets(sums, weights, share, cap).withColumn("cells", F.ceil(F.sqrt("n_docs"))), "mix-targets")
    info = wanted.withColumnRenamed("source", "s")
    level = levels(classes.join(info.select("s", "target"), F.col("source").eqNullSafe(F.col("s"))).select("source", "weight", "size", "target"), cap)
    info = stored(info.join(level.withColumnRenamed("source", "s3"), F.col("s").eqNullSafe(F.col("s3"))).drop("s3"), "mix-levels")
    expected = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(float(cap)), F.col("level") * F.col("weight")), F.when(F.col("weight") > 0, F.lit(float(cap))).otherwise(0.0)))
    rows = base.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    p = F.when(F.col("size") > 0, F.col("expected") - F.col("whole")).otherwise(0.0)  # a text without words adds nothing to the words wanted and is not drawn
    odds = F.col("u") * (1 - p) / (F.col("u") * (1 - p) + (1 - F.col("u")) * p)  # q / (1 + q) for the ratio q of odds: the same order
    rows = rows.withColumn("rank_by", F.when(p > 0, odds)).withColumn("cell", F.when(F.col("rank_by").isNotNull(), F.least(F.floor(F.col("rank_by") * F.col("cells")), F.col("cells") - 1)))

    cells = rows.groupBy("source", "cell").agg(F.sum(F.when(F.col("cell").isNotNull(), F.col("size")).otherwise(0)).alias("cell_size"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    along = Window.partitionBy("source").orderBy(F.col("cell").asc_nulls_first())
    cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), "cell_size", (F.sum("cell_size").over(along) - F.col("cell_size")).alias("before"), (F.col("target") - F.sum("certain").over(Window.partitionBy("source"))).alias("rest"))
    cells = stored(cells.where(F.col("c").isNotNull()), "mix-cells")
    edge = cells.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("cell_size") > F.col("rest")))
    # The cells up to the edge are whole; a source without an edge takes all or none.
    last = cells.groupBy("s").agg(F.first("rest").alias("rest"), F.max(F.when(F.col("before") + F.col("cell_size") <= F.col("rest"), F.col("c"))).alias("full_to"))
    last = last.withColumnRenamed("s", "s2")
    keyed = rows.join(last, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2", "rest")
    keyed = keyed.join(edge.select("s", "c", "before", "rest"), F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")), "left").drop("s", "c")
    done = keyed.where(F.col("rest").isNull()).withColumn("extra", F.coalesce((F.col("cell") <= F.col("full_to")).cast("long"), F.lit(0)))
    in_cell = Window.partitionBy("source", "cell").orderBy("rank_by", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    cut = keyed.where(F.col("rest").isNotNull()).withColumn("extra", (F.col("before") + F.sum("size").over(in_cell) - F.col("size") / 2.0 <= F.col("rest")).cast("long"))
    copies = F.col("whole") + F.col("extra")
    out = ["doc_id", "source", "size", "source_size", "target", "expected", "whole", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *carry]
    return done.select(*out).unionByName(cut.select(*out))


#: The contract's weights.
WEIGHTS = [3, 1, 2]


def op1_pareto_mix(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sized AS (SELECT *, length(bin(size)) AS weight FROM base),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS share FROM sums),
ratio AS (SELECT *, 2.0::DOUBLE * source_size / share AS full_at FROM ranked),
heights AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
    - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(share) OVER (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS height FROM ratio),
water AS (SELECT arg_min(height, full_at) AS height FROM heights WHERE full_at >= height),
goal AS (SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, share * (SELECT height FROM water)), 2.0::DOUBLE * source_size) AS target FROM ratio),
classes AS (SELECT s.source, s.weight, CAST(sum(s.size) AS BIGINT) AS size, any_value(g.target) AS target FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source GROUP BY s.source, s.weight),
leveled AS (SELECT source, weight, CASE WHEN sum(weight * size) OVER onward > 0 THEN (target - 2.0::DOUBLE * CAST(coalesce(sum(size) OVER above, 0) AS DOUBLE)) / CAST(sum(weight * size) OVER onward AS DOUBLE) END AS level FROM classes
  WINDOW above AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), onward AS (PARTITION BY source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT source, arg_max(level, weight) FILTER (weight * level <= 2.0::DOUBLE) AS level FROM leveled GROUP BY source),
joined AS (SELECT b.*, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0.0::DOUBLE ELSE coalesce(least(2.0::DOUBLE, l.level * b.weight), 2.0::DOUBLE) END AS expected
  FROM sized b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source JOIN level l ON b.source IS NOT DISTINCT FROM l.source),
odds AS (SELECT *, floor(expected) AS whole, CASE WHEN size > 0 THEN expected - floor(expected) ELSE 0 END AS p FROM joined),
ordered AS (SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS rank_by,
    target - CAST(sum(whole * size) OVER (PARTITION BY source) AS DOUBLE) AS rest FROM odds),
cum AS (SELECT *, sum(CASE WHEN rank_by IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank_by NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM ordered),
picked AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN rank_by IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM cum)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM picked
"""
