"""Connected components of links by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: Rows that one task takes: tables shrink from round to round, and a small one is not worth a task a shuffle partition.
TASK_ROWS = 200_000


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, in tasks of about TASK_ROWS; a shuffle of fewer partitions stays as it is."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) of long ids: (id, root) for every linked id, root the same for all that are joined and itself one of them.

    Each round every vertex points to its smallest neighbour other than itself. Pointers form trees whose only cycles are two vertices that point to each other, of which the
    smaller becomes the root; paths are halved until every vertex points to its root, then labels and links are renamed and links within one vertex go. A tree has two vertices
    at least, so at least half the vertices that still have links vanish each round, and a tree of any depth takes about log2(depth) halvings.
    Links may repeat or join an id to itself; empty links give no rows. A hub's links are only ever counted by partial sums or joined, never gathered.
    """
    links = stored(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    n = links.count()
    labels = stored(_sized(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().select("id", F.col("id").alias("root")), 2 * n), "labels")
    named = labels.count()
    while n:
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        most = min(2 * n, named)
        to = _rooted(stored(_sized(ends.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("v"), "to"), most), "links-to"), most)
        name = lambda df, c: df.join(to.select(F.col("v").alias(f"v_{c}"), F.col("to").alias(f"to_{c}")), F.col(c) == F.col(f"v_{c}"), "left").withColumn(c, F.coalesce(f"to_{c}", c)).drop(f"v_{c}", f"to_{c}")
        old = (links, labels, to)
        labels = stored(_sized(name(labels, "root"), named), "labels")
        links = name(name(links, "a"), "b").where("a != b")
        links = stored(_sized(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), n), "links")
        n = links.count()
        dropped(*old)
    dropped(links)
    return labels


def _rooted(to: DataFrame, rows: int) -> DataFrame:
    """Pointers (v, to) followed to their roots. On the first pass a pair that point to each other get the smaller as root."""
    mutual, moved = True, True
    while moved:
        up = to.select(F.col("v").alias("w"), F.col("to").alias("up"))
        far = F.when(F.col("up") == F.col("v"), F.least("v", "to")).otherwise(F.col("up")) if mutual else F.col("up")
        further = stored(_sized(to.join(up, F.col("to") == F.col("w")).select("v", far.alias("to"), (far != F.col("to")).alias("moved")), rows), "links-to")
        dropped(to)
        moved, mutual, to = mutual or not further.where("moved").isEmpty(), False, further
    return to
