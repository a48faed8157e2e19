"""A table folder as a database: immutable Parquet runs, an append-only manifest, families, snapshots and checkpoints.

The folder holds runs/<n> (one per commit or compaction), manifest/<version> and families. A commit is visible once its manifest version is written. A version is claimed by a file
that only one writer can create; a writer that comes second is refused and may try again. Runs are sorted by family and key, so that bounds on the key prune them by their statistics.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.maintenance import compaction_verdicts
from ..operators.visibility import visible
from .oplog import OP_LOG, numbered, validated

MANIFEST = "version long, run long, path string, first_seq long, last_seq long, ops long, added boolean"
FAMILIES = "version long, id int, name string, active boolean"


class StoreError(Exception):
    """A store refuses an operation."""


@dataclass
class Plugin:
    """Calls around a commit. before may change or refuse a batch (its result is validated again); a failing after never takes a commit back."""

    name: str
    before: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[int], None] | None = None
    fail_fast: bool = True
    failures: list[str] = field(default_factory=list)


class Store:
    """Opens a folder; with create, makes an empty store where there is none. A read-only store writes nothing."""

    def __init__(self, spark: SparkSession, path: str, create: bool = True, error_if_exists: bool = False, read_only: bool = False, plugins: list[Plugin] | None = None):
        self.spark, self.path, self.read_only, self.plugins = spark, path.rstrip("/"), read_only, plugins or []
        there = self._edits() is not None
        if there and error_if_exists:
            raise StoreError("the store exists")
        if not there:
            if read_only or not create:
                raise StoreError("there is no store here")
            self._write(spark.createDataFrame([(0, 0, None, None, 0, 0, False)], MANIFEST), "manifest/0")
            self._write(spark.createDataFrame([(0, 1, "default", True)], FAMILIES), "families/0")

    def _write(self, df: DataFrame, name: str) -> str:
        if self.read_only:
            raise StoreError("the store is read-only")
        df.write.parquet(f"{self.path}/{name}")
        return f"{self.path}/{name}"

    def _publish(self, version: int, rows: DataFrame) -> None:
        """Writes a manifest version, or refuses: of two writers that read one state, one goes on. A claim goes again if the write fails; one that a dying writer left is removed by hand."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/claims/{version}")
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.createNewFile(path):
            raise StoreError("another writer has taken this version")
        try:
            self._write(rows.coalesce(1), f"manifest/{version}")
        except Exception:
            files.delete(path, False)
            raise

    def _edits(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return None

    def files(self, version: int | None = None) -> DataFrame:
        """Runs of a version of the manifest."""
        edits = self._edits()
        own = edits if version is None else edits.where(F.col("version") <= version)
        newest = own.where("run > 0").groupBy("run").agg(F.max_by(F.struct("path", "first_seq", "last_seq", "ops", "added"), "version").alias("e"))
        return newest.where("e.added").select("run", "e.path", "e.first_seq", "e.last_seq", "e.ops")

    def state(self) -> tuple[int, int, int]:
        """Newest version, newest run, last sequence number."""
        row = self._edits().agg(F.max("version"), F.max("run"), F.max("last_seq")).head()
        return row[0], row[1], row[2]

    def log(self, version: int | None = None) -> DataFrame:
        """The op log of a version; a store's runs are few and listed in its manifest."""
        paths = [r.path for r in self.files(version).select("path").collect()]
        return self.spark.read.schema(OP_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], OP_LOG)

    def snapshot(self) -> int:
        """The last sequence number: reads at it never change, and compaction keeps what it needs when told to retain it."""
        return self.state()[2]

    def write(self, batches: DataFrame) -> int:
        """Commits batches (OP_LOG columns but seq), all or nothing; returns the last sequence number. An empty batch takes none."""
        if self.read_only:
            raise StoreError("the store is read-only")
        version, run, last = self.state()
        ops = validated(batches)
        for p in self.plugins:
            if p.before:
                try:
                    ops = validated(p.before(ops))
                except Exception as e:
                    if p.fail_fast:
                        raise
                    p.failures.append(str(e))
        known = [r.id for r in self.families().where("active").select("id").collect()]
        ops = ops.withColumn("cf_id", F.when(F.col("cf_id").isin(known), F.col("cf_id")).otherwise(F.raise_error(F.lit("an unknown family")).cast("int")))
        path = self._write(numbered(ops, last).select(*OP_LOG.names).repartitionByRange("cf_id", "key").sortWithinPartitions("cf_id", "key", F.col("seq").desc()), f"runs/{run + 1}-{uuid.uuid4().hex[:8]}")
        count, top = self.spark.read.schema(OP_LOG).parquet(path).agg(F.count(F.lit(1)), F.max("seq")).head()
        if count:
            self._publish(version + 1, self.spark.createDataFrame([(version + 1, run + 1, path, last + 1, top, count, True)], MANIFEST))
        for p in self.plugins:
            if p.after:
                try:
                    p.after(top or last)
                except Exception as e:
                    p.failures.append(str(e))
        return top or last

    def live(self, seq: int | None = None) -> DataFrame:
        return visible(self.log(), seq)

    def compact(self, retain_seq: int | None = None) -> int:
        """Rewrites all runs as one without the ops that no read at or after retain_seq (the last by default) needs; returns the ops left."""
        version, run, last = self.state()
        old = self.files().select("run", "path", "first_seq", "last_seq", "ops")
        kept = compaction_verdicts(self.log(), last if retain_seq is None else retain_seq, base_level=False)
        # An add needs the value under it: ops of keys with adds all stay.
        added = self.log().where("op = 3").select("cf_id", "key").distinct().withColumn("adds", F.lit(True))
        kept = kept.join(added, ["cf_id", "key"], "left").where("keep OR adds").select(*OP_LOG.names)
        path = self._write(kept.repartitionByRange("cf_id", "key").sortWithinPartitions("cf_id", "key", F.col("seq").desc()), f"runs/{run + 1}-{uuid.uuid4().hex[:8]}")
        count = self.spark.read.schema(OP_LOG).parquet(path).count()
        gone = old.select(F.lit(version + 1).alias("version"), "run", "path", "first_seq", "last_seq", "ops", F.lit(False).alias("added"))
        new = self.spark.createDataFrame([(version + 1, run + 1, path, 1, last, count, True)], MANIFEST)
        self._publish(version + 1, gone.union(new))
        return count

    def families(self) -> DataFrame:
        """id, name, active: ids are never used again."""
        edits = self.spark.read.schema(FAMILIES).option("recursiveFileLookup", "true").parquet(f"{self.path}/families")
        return edits.groupBy("id").agg(F.max_by(F.struct("name", "active"), "version").alias("e")).select("id", "e.name", "e.active")

    def _family(self, id_: int, name: str, active: bool) -> None:
        version = self.spark.read.schema(FAMILIES).option("recursiveFileLookup", "true").parquet(f"{self.path}/families").agg(F.max("version")).head()[0] + 1
        self._write(self.spark.createDataFrame([(version, id_, name, active)], FAMILIES).coalesce(1), f"families/{version}")

    def create_family(self, name: str) -> int:
        rows = self.families().collect()
        if any(r.active and r.name == name for r in rows):
            raise StoreError("a family has that name")
        new = max(r.id for r in rows) + 1
        self._family(new, name, True)
        return new

    def rename_family(self, id_: int, name: str) -> None:
        rows = self.families().where("active").collect()
        if all(r.id != id_ for r in rows) or any(r.name == name for r in rows):
            raise StoreError("no such family, or the name is taken")
        self._family(id_, name, True)

    def drop_family(self, id_: int) -> None:
        row = self.families().where((F.col("id") == id_) & F.col("active")).head()
        if id_ == 1 or row is None:
            raise StoreError("the default family stays, and others must exist")
        self._family(id_, row.name, False)

    def checkpoint(self, target: str) -> int:
        """Copies the newest version to an empty folder, as one run; returns its ops, checked against the source."""
        _, _, last = self.state()
        rows = self.log()
        count = rows.count()
        copy = Store(self.spark, target, error_if_exists=True)
        path = copy._write(rows, "runs/1")
        if self.spark.read.schema(OP_LOG).parquet(path).count() != count:
            raise StoreError("the copy differs from its source")
        copy._write(self.spark.createDataFrame([(1, 1, path, 1, last, count, True)], MANIFEST).coalesce(1), "manifest/1")
        copy._write(self.families().select(F.lit(1).cast("long").alias("version"), "id", "name", "active").coalesce(1), "families/1")
        return count

    def check(self) -> list[str]:
        """What is wrong with the store, as text; never raises for damage."""
        found = []
        for r in self.files().collect():
            try:
                n, top = self.spark.read.schema(OP_LOG).parquet(r.path).agg(F.count(F.lit(1)), F.max("seq")).head()
                if n != r.ops or (top or 0) > r.last_seq:
                    found.append(f"run {r.run} holds {n} ops, the manifest says {r.ops}")
            except Exception as e:
                found.append(f"run {r.run} can't be read: {type(e).__name__}")
        return found

    def properties(self) -> dict[str, str]:
        version, _, last = self.state()
        row = self.files().agg(F.count(F.lit(1)), F.coalesce(F.sum("ops"), F.lit(0))).head()
        return {"version": str(version), "last_sequence": str(last), "runs": str(row[0]), "ops": str(row[1]), "families": str(self.families().where("active").count())}
