"""Maintenance of logs and file tables as queries: compaction, sizes, overlap, obsolete files, backups, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import DELETE, DELETE_RANGE

def compaction_verdicts(log: DataFrame, retain_seq: int, base_level: bool = True) -> DataFrame:
    """Adds keep: whether compaction keeps an op that no reader at or after `retain_seq` can do without.

    Of a key's ops up to retain_seq the newest stays, unless it is a delete at the base level; newer ops and range deletes always stay. Adds stay: they build on what is before them.
    Ops of one key are numbered all together, tombstones that begin at the key included.
    """
    newer = Window.partitionBy("cf_id", "key").orderBy(F.col("seq").desc())
    hidden = F.coalesce(F.lag("seq").over(newer) <= retain_seq, F.lit(False))
    dropped = (F.col("op") != DELETE_RANGE) & (hidden | (F.lit(base_level) & (F.col("op") == DELETE) & (F.col("seq") <= retain_seq)))
    return log.withColumn("keep", ~dropped)


def compacted(log: DataFrame, retain_seq: int) -> DataFrame:
    """A log of puts and deletes without what compaction drops. Deletes stay where a range of keys may still hold older puts (no base level is known)."""
    return compaction_verdicts(log, retain_seq, base_level=False).where("keep").drop("keep")


def _bytes(column: str):
    return F.coalesce(F.octet_length(F.col(column).cast("string").cast("binary")), F.lit(0))


def approximate_size(log: DataFrame, low, high, cf_id: int = 1) -> DataFrame:
    """Exact bytes of keys and values in [low, high)."""
    own = log.where((F.col("cf_id") == cf_id) & (F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))
    return own.agg(F.coalesce(F.sum(_bytes("key") + _bytes("value")), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("ops"))


def range_sizes(log: DataFrame, ranges: list[tuple], cf_id: int = 1) -> DataFrame:
    """approximate_size of several ranges in one scan: place, bytes, ops, in the order asked. Ranges may overlap; an op counts in each that holds it. The list is the caller's own, so it is small."""
    own = log.where(F.col("cf_id") == cf_id)
    sums = []
    for i, (low, high) in enumerate(ranges):
        inside = (F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high))
        sums.append(F.struct(F.lit(i).cast("long").alias("place"), F.coalesce(F.sum(F.when(inside, _bytes("key") + _bytes("value"))), F.lit(0)).cast("long").alias("bytes"), F.count_if(inside).alias("ops")))
    return own.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def live_bytes(live: DataFrame) -> DataFrame:
    """Keys and bytes of the live set of each family."""
    return live.groupBy("cf_id").agg(F.count(F.lit(1)).alias("keys"), F.sum(_bytes("key") + _bytes("value")).cast("long").alias("bytes"))


def file_types(files: DataFrame, name: str = "name") -> DataFrame:
    """Files and bytes by type, told by name: current, lock, info_log, manifest, log, table, temp. Other names are not counted."""
    of = F.col(name)
    kind = (
        F.when(of == "CURRENT", "current").when(of == "LOCK", "lock").when(of.isin("LOG", "LOG.old"), "info_log").when(of.startswith("MANIFEST-"), "manifest")
        .when(of.endswith(".log"), "log").when(of.endswith(".sst"), "table").when(of.endswith(".dbtmp"), "temp")
    )
    return files.where(kind.isNotNull()).groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def level_files(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("cf_id", "level").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def overlaps(files: DataFrame, others: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs of files with equal `keys` whose [smallest_key, largest_key] meet: whole-number keys in buckets of `width`, a pair in the first bucket that both have."""

    def bucketed(df: DataFrame, end: str) -> DataFrame:
        lo, hi = F.floor(F.col("smallest_key") / width), F.floor(F.col("largest_key") / width)
        return df.select(*keys, *[F.col(c).alias(f"{c}_{end}") for c in ("file_no", "size", "smallest_key", "largest_key")], lo.alias(f"lo_{end}"), F.explode(F.sequence(lo, hi)).alias("bucket"))

    pairs = bucketed(files, "a").join(bucketed(others, "b"), [*keys, "bucket"])
    return pairs.where("bucket = greatest(lo_a, lo_b) AND smallest_key_a <= largest_key_b AND smallest_key_b <= largest_key_a").drop("bucket", "lo_a", "lo_b")


def next_level_overlap(manifest: DataFrame) -> DataFrame:
    """Most bytes of the next level that one file of a level (1 and below) meets."""
    below = manifest.withColumn("level", F.col("level") - 1)
    per_file = overlaps(manifest.where("level >= 1"), below, ["cf_id", "level"]).groupBy("cf_id", "level", "file_no_a").agg(F.sum("size_b").alias("bytes"))
    return per_file.groupBy("cf_id", "level").agg(F.max("bytes").cast("long").alias("overlap_bytes"))


def current_files(edits: DataFrame, version: int | None = None) -> DataFrame:
    """Files of a manifest version: those whose newest edit added them."""
    own = edits if version is None else edits.where(F.col("version") <= version)
    newest = F.max_by(F.struct(*[c for c in edits.columns if c not in ("file_no",)]), "version").alias("e")
    return own.groupBy("file_no").agg(newest).where("e.added").select("file_no", "e.*").drop("added")


def obsolete_files(present: DataFrame, live: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Files present that neither a pinned version nor a pending write needs."""
    kept = live.select("file_no") if pending is None else live.select("file_no").union(pending.select("file_no"))
    return present.join(kept, "file_no", "left_anti")


def backup_plan(source: DataFrame, last_backup: DataFrame) -> DataFrame:
    """Which files an incremental backup copies and which it takes from the last one: those of equal name and length."""
    same = last_backup.select("name", "size").distinct().withColumn("reused", F.lit(True))
    return source.join(same, ["name", "size"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def object_refs(backups: DataFrame) -> DataFrame:
    """Backups that hold each content object; its id is name, length and checksum."""
    object_id = F.concat_ws("-", "name", F.col("size").cast("string"), F.lower(F.hex("crc32")))
    return backups.withColumn("object_id", object_id).groupBy("object_id").agg(F.countDistinct("backup_id").alias("refs"), F.min("backup_id").alias("first_backup"), F.max("backup_id").alias("last_backup"))


def purge(backups: DataFrame, keep_last: int) -> DataFrame:
    """Backups beyond the newest `keep_last`."""
    if keep_last < 0:
        raise ValueError("keep_last must not be negative")
    ids = backups.select("backup_id").distinct()
    return ids.join(ids.orderBy(F.col("backup_id").desc()).limit(keep_last), "backup_id", "left_anti")


def purgeable_objects(objects: DataFrame, purged: DataFrame) -> DataFrame:
    """Content objects (object_id, backup_id) of purged backups that no backup retained holds: what a purge may delete."""
    gone = objects.join(purged, "backup_id", "left_semi").select("object_id").distinct()
    return gone.join(objects.join(purged, "backup_id", "left_anti").select("object_id"), "object_id", "left_anti")


def orphan_objects(objects: DataFrame, referenced: DataFrame) -> DataFrame:
    """Content objects present that no backup names."""
    return objects.join(referenced.select("object_id"), "object_id", "left_anti")


def integrity(manifest: DataFrame, present: DataFrame, families: DataFrame) -> DataFrame:
    """Failures of a manifest against the files present and the families known: file_no, problem."""
    missing = manifest.join(present, "file_no", "left_anti").select("file_no", F.lit("missing file").alias("problem"))
    both = manifest.join(present.select("file_no", F.col("size").alias("real_size")), "file_no")
    wrong = both.where("size != real_size").select("file_no", F.lit("wrong size").alias("problem"))
    bounds = manifest.where("smallest_key > largest_key").select("file_no", F.lit("bounds out of order").alias("problem"))
    unknown = manifest.join(families.where("active"), F.col("cf_id") == F.col("id"), "left_anti").select("file_no", F.lit("unknown family").alias("problem"))
    return missing.union(wrong).union(bounds).union(unknown)


def verify_model(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Keys whose live sequence number or value is not the expected one: cf_id, key, problem."""
    e = expected.select("cf_id", "key", F.col("seq").alias("want_seq"), F.col("value").alias("want"))
    both = e.join(live.select("cf_id", "key", "seq", "value"), ["cf_id", "key"], "full")
    problem = F.when(F.col("seq").isNull(), "lost").when(F.col("want_seq").isNull(), "unexpected").when(F.col("seq") != F.col("want_seq"), "other version").when(~F.col("value").eqNullSafe(F.col("want")), "other value")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("cf_id", "key", "problem")


def verify_ledger(ledger: DataFrame, active: DataFrame, live: DataFrame) -> DataFrame:
    """Checks recent operations (kind WRITE or REMOVE, key, seq) against committed state (key, seq) and the live set (key, seq): key, seq, problem.

    A write counts only while it is its key's committed one; then the live value must be that one. A removed key with no committed value must not be live.
    """
    state = active.select("key", F.col("seq").alias("current"))
    there = live.select("key", F.col("seq").alias("found"))
    both = ledger.join(state, "key", "left").join(there, "key", "left")
    write = (F.col("kind") == "WRITE") & (F.col("current") == F.col("seq"))
    problem = F.when(write & F.col("found").isNull(), "lost").when(write & (F.col("found") != F.col("seq")), "other version").when((F.col("kind") == "REMOVE") & F.col("current").isNull() & F.col("found").isNotNull(), "removed key is live")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("key", "seq", "problem")
