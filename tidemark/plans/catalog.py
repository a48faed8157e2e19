"""Queries by name over the driver's tables, and the SQL that each must equal.

Each takes (spark, folder of tables). The op log is read from `events` as tidemark.sources.oplog maps it; a manifest of files is read from `orders`, samples and faults from `events`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import described_value, value_problem
from ..operators import maintenance as m
from ..operators import reads, reports, visibility
from ..sources.oplog import EVENT_COLUMNS, event_log, numbered, ordered_by

#: Keys that the queries ask for.
KEYS = [3, 149, 3, 9999, 0, 77]

FILES = {
    "file_no": "o_orderkey", "cf_id": "CAST(o_orderkey % 3 AS INT) + 1", "level": "CAST(o_custkey % 7 AS INT)", "size": "CAST(floor(o_totalprice * 100) AS BIGINT)",
    "smallest_key": "o_custkey", "largest_key": "o_custkey + o_orderkey % 5", "version": "CAST(floor(o_totalprice) AS BIGINT) % 10",
    "name": "concat('f', CAST(o_orderkey % 500 AS STRING))", "crc32": "o_custkey % 97", "backup_id": "o_orderkey % 11",
}

#: Names of files made up from order numbers, one form for each file type and one that is none.
FILE_NAME = """CASE o_orderkey % 8 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'LOCK' WHEN 2 THEN 'LOG.old' WHEN 3 THEN concat('MANIFEST-', CAST(o_orderkey AS STRING))
  WHEN 4 THEN concat(CAST(o_orderkey AS STRING), '.log') WHEN 5 THEN concat(CAST(o_orderkey AS STRING), '.sst') WHEN 6 THEN concat(CAST(o_orderkey AS STRING), '.dbtmp') ELSE 'notes.txt' END"""


def _log(spark, d: str, families: bool = False) -> DataFrame:
    return event_log(spark.read.parquet(f"{d}/events.parquet"), families)


def _files(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} AS {c}" for c, e in FILES.items()])


def _plain(df: DataFrame) -> DataFrame:
    return df.select("key", "seq", "value")


def _strings(spark, d: str) -> DataFrame:
    """Customers as an op log with text keys, each put once; every tenth is deleted after."""
    customers = spark.read.parquet(f"{d}/customer.parquet")
    puts = customers.select(F.lit(1).alias("cf_id"), F.col("c_custkey").alias("seq"), F.lit(1).alias("op"), F.col("c_name").alias("key"), F.lit(None).cast("string").alias("end_key"), F.col("c_nationkey").cast("long").alias("value"))
    gone = customers.where("c_custkey % 10 = 0").select(F.lit(1).alias("cf_id"), (F.col("c_custkey") + 10_000_000).alias("seq"), F.lit(0).alias("op"), F.col("c_name").alias("key"), F.lit(None).cast("string").alias("end_key"), F.lit(None).cast("long").alias("value"))
    return puts.unionByName(gone)


def _values(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_type", "value", "user_id", F.col("event_id").alias("id"), (F.col("value") * 40).alias("micros"))


def _newest(log: DataFrame) -> int:
    """The newest sequence number, by a one-row aggregate; -1 for an empty log."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("seq")).head().seq


def _late(log: DataFrame) -> int:
    """The snapshot at which the queries read, at nine tenths of the log: it grows with it."""
    return _newest(log) * 9 // 10


def kv_multi_get(spark, d):
    log = _log(spark, d)
    return reads.multi_get(log, KEYS, seq=_late(log))


def kv_verify_model(spark, d):
    log = _log(spark, d)
    late = _late(log)
    model = visibility.latest(visibility.as_of(log, late)).where("op = 1")
    return m.verify_model(model, visibility.visible(log, late)).select("key", "problem")


def kv_compact_survivors(spark, d):
    log = _log(spark, d)
    kept = m.compaction_verdicts(log.where("op != 3"), _late(log)).where("keep")
    return kept.select("key", "seq", "op")


def kv_compact_live(spark, d):
    log = _log(spark, d)
    return _plain(visibility.visible(m.compacted(log.where("op != 3"), _late(log)), None))


def kv_live_as_of_whole(spark, d):
    log = _log(spark, d)
    return _plain(visibility.visible(log, _late(log)))


def kv_verify_model_whole(spark, d):
    log = _log(spark, d)
    return m.verify_model(visibility.latest(log).where("op = 1"), visibility.visible(log)).select("key", "problem")


def kv_snapshot_diff_whole(spark, d):
    log = _log(spark, d)
    newest = _newest(log)
    return reads.snapshot_diff(log, newest * 4 // 9, newest).drop("cf_id")


def _verdicts_whole(spark, d):
    log = _log(spark, d)
    return m.compaction_verdicts(log.where("op != 3"), _newest(log))


def kv_compact_dropped_whole(spark, d):
    return _verdicts_whole(spark, d).groupBy(F.col("op").cast("int").alias("op")).agg(F.count(F.lit(1)).alias("ops"), F.count_if(~F.col("keep")).alias("dropped"))


def kv_compact_live_whole(spark, d):
    log = _log(spark, d)
    return _plain(visibility.visible(m.compacted(log.where("op != 3"), _newest(log))))


def kv_integrity_check(spark, d):
    files = _files(spark, d)
    present = files.where("file_no % 13 != 0").select("file_no", F.when(F.col("file_no") % 17 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    families = spark.createDataFrame([(1, "default", True), (2, "meta", True), (3, "old", False)], "id int, name string, active boolean")
    return m.integrity(files, present, families)


def kv_gc_obsolete(spark, d):
    files = _files(spark, d)
    edits = files.select("file_no", "version", F.lit(True).alias("added")).union(files.where("cf_id = 2").select("file_no", F.lit(99).cast("long").alias("version"), F.lit(False).alias("added")))
    return m.obsolete_files(files.select("file_no", "size"), m.current_files(edits))


def kv_backup_reuse(spark, d):
    files = _files(spark, d).select("name", "size", "backup_id")
    plan = m.backup_plan(files.where("backup_id = 10").select("name", "size"), files.where("backup_id < 10").select("name", (F.col("size") - F.col("size") % 7).alias("size")))
    return plan.groupBy("reused").agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


def kv_batch_sequence(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("op_index"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("supp"))
    ordered = lines.withColumn("op_index", F.struct("op_index", "key", "supp"))
    return numbered(ordered, 1000).groupBy("batch_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _counters(spark, d):
    """Samples of cumulative counters by user; the first restarts from 0 where it reaches 5000."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type", "event_id", F.floor("value").cast("long").alias("step"))
    kinds = {"reads": ["view", "click"], "writes": ["signup", "purchase"], "removes": ["error"]}
    return events.select("user_id", (F.col("event_id") * 250).alias("time_millis"), (F.sum("step").over(order) % 5000).alias("operations"), *[F.sum(F.when(F.col("event_type").isin(v), F.col("step")).otherwise(0)).over(order).alias(k) for k, v in kinds.items()])


def rep_rates(spark, d):
    return reports.rates(_counters(spark, d), "user_id", "time_millis", "operations")


def rep_rate_summaries(spark, d):
    rates = reports.rates(_counters(spark, d), "user_id", "time_millis", "reads", "writes", "removes")
    long = rates.select(F.explode(F.array(*[F.struct(F.concat_ws(":", "user_id", F.lit(k)).alias("series"), F.col(f"{k}_rate").alias("rate")) for k in ("reads", "writes", "removes")])).alias("r")).select("r.*")
    return reports.summary(long, "series", "rate").select("series", "n", F.round("avg", 6).alias("avg"), "min", "max", "p05", "p50", "p95")


def rep_run_summary(spark, d):
    samples = _values(spark, d).withColumn("span", (F.col("id") % 9 + 1).cast("long"))
    kept = reports.steady(samples, "user_id", "id", "span")
    return reports.summary(kept, "user_id", "value").select("user_id", "n", F.round("avg", 6).alias("avg"), "min", "max", "p05", "p50", "p95", F.round("drop", 9).alias("drop"))


def _faults(spark, d):
    return _values(spark, d).select(F.col("event_type").alias("kind"), F.expr("CASE id % 5 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'DETECTED' WHEN 2 THEN 'DETECTED_BY_VERIFY' WHEN 3 THEN 'UNEXPECTED_OPEN' ELSE 'SKIPPED' END").alias("status"))


def kv_value_check(spark, d):
    """Self-describing values of all orders, of which some are damaged as told by the order's number, and what is found wrong."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    sound = orders.withColumn("value", described_value(F.col("o_custkey"), F.col("o_orderkey"), (F.col("o_orderkey") % 90).cast("int"), 20260602))
    flipped = F.concat(F.expr("substring(value, 1, 16)"), F.unhex(F.lpad(F.hex(F.pmod(F.conv(F.hex(F.expr("substring(value, 17, 1)")), 16, 10).cast("long") + 1, F.lit(256))), 2, "0")), F.expr("substring(value, 18)"))
    number = F.col("o_orderkey")
    damaged = F.when(number % 13 == 0, F.lit(None)).when(number % 11 == 0, F.expr("substring(value, 1, 20)")).when(number % 7 == 0, flipped).otherwise(F.col("value"))
    asked = F.when(number % 5 == 0, number + 1).otherwise(number)
    return sound.select("o_orderkey", value_problem(damaged, F.col("o_custkey"), asked).alias("problem")).where("problem IS NOT NULL")


def kv_verify_ledger(spark, d):
    """The newest put or delete of every key in the ledger, older ones too, against the live set, in which range deletes hide keys."""
    log = _log(spark, d)
    ledger = log.where("op IN (0, 1)").select(F.when(F.col("op") == 1, "WRITE").otherwise("REMOVE").alias("kind"), "key", "seq")
    return m.verify_ledger(ledger, visibility.latest(log).where("op = 1"), visibility.visible(log).where("seq % 11 != 0"))


def _objects(spark, d):
    return _files(spark, d).select(F.concat_ws("-", "name", F.col("size").cast("string")).alias("object_id"), "backup_id")


def kv_purge_objects(spark, d):
    objects = _objects(spark, d)
    return m.purgeable_objects(objects, m.purge(objects, 4))


def kv_limited_scan(spark, d):
    """The first 25 live customers, keys and values as base64, and whether there are more."""
    log = _strings(spark, d).withColumn("key", F.col("key").cast("binary")).withColumn("end_key", F.col("end_key").cast("binary")).withColumn("value", F.col("value").cast("string").cast("binary"))
    rows, more = reads.limited_scan(log, 25)
    return rows.withColumn("truncated", F.lit(more))


def kv_custom_order(spark, d):
    """Customers in the order of their names read backwards, from one name to another."""
    log = ordered_by(_strings(spark, d), F.reverse)
    low, high = (F.struct(F.lit(x[::-1]).alias("sort_key"), F.lit(x).alias("key")) for x in ("Customer#000000001", "Customer#000000005"))
    return reads.scan(log, low=low, high=high).select("key.key", "seq", "value")


QUERIES = {
    "kv_live_latest": lambda s, d: _plain(visibility.visible(_log(s, d))),
    "kv_live_as_of": lambda s, d: _plain(visibility.visible(log := _log(s, d), _late(log))),
    "kv_live_swept": lambda s, d: _plain(visibility.visible(log := _log(s, d), _late(log), "sweep")),
    "kv_point_get": lambda s, d: _plain(reads.get(log := _log(s, d), 149, seq=_late(log))),
    "kv_multi_get": kv_multi_get,
    "kv_scan_limit": lambda s, d: _plain(reads.scan(log := _log(s, d), seq=_late(log), limit=20)),
    "kv_reverse_scan": lambda s, d: _plain(reads.scan(log := _log(s, d), seq=_late(log), reverse=True)),
    "kv_seek": lambda s, d: _plain(reads.seek(log := _log(s, d), 50, seq=_late(log))),
    "kv_seek_for_prev": lambda s, d: _plain(reads.seek_for_prev(log := _log(s, d), 50, seq=_late(log))),
    "kv_range_scan": lambda s, d: _plain(reads.scan(log := _log(s, d), seq=_late(log), low=20, high=90)),
    "kv_prefix_scan": lambda s, d: _plain(reads.scan(_strings(s, d), prefix="Customer#00000")),
    "kv_first_last": lambda s, d: reads.first_last(log := _log(s, d, True), _late(log)),
    "kv_delete_mask": lambda s, d: visibility.latest(_log(s, d)).select("key", "seq", F.col("op").cast("int").alias("op"), "value"),
    "kv_range_delete_mask": lambda s, d: visibility.newest_cover(visibility.latest(_log(s, d)).select("cf_id", "key", "seq"), visibility.ranges(_log(s, d))).select("key", "seq", "cover"),
    "kv_counter_final": lambda s, d: visibility.counters(_log(s, d)).select("key", "value"),
    "kv_counter_as_of": lambda s, d: visibility.counters(log := _log(s, d, True), _late(log)).select("cf_id", "key", "value"),
    "kv_counter_history": lambda s, d: visibility.counter_history(_log(s, d)).select("key", "seq", "value"),
    "kv_key_history": lambda s, d: reads.history(_log(s, d), 3).select("seq", F.col("op").cast("int").alias("op"), "value", "delta"),
    "kv_raw_scan": lambda s, d: reads.raw(_log(s, d, True), 2).select("key", "seq", F.col("op").cast("int").alias("op")),
    "kv_snapshot_diff": lambda s, d: reads.snapshot_diff(log := _log(s, d), _newest(log) * 4 // 9, _late(log)).drop("cf_id"),
    "kv_cf_isolation": lambda s, d: visibility.visible(log := _log(s, d, True), _late(log)),
    "kv_batch_sequence": kv_batch_sequence,
    "kv_compact_survivors": kv_compact_survivors,
    "kv_compact_dropped": lambda s, d: m.compaction_verdicts((log := _log(s, d)).where("op != 3"), _late(log)).groupBy(F.col("op").cast("int").alias("op")).agg(F.count(F.lit(1)).alias("ops"), F.count_if(~F.col("keep")).alias("dropped")),
    "kv_compact_live": kv_compact_live,
    "kv_approx_size": lambda s, d: m.approximate_size(_log(s, d), 10, 100),
    "kv_level_files": lambda s, d: m.level_files(_files(s, d)),
    "kv_level_overlap": lambda s, d: m.next_level_overlap(_files(s, d)),
    "kv_gc_obsolete": kv_gc_obsolete,
    "kv_backup_reuse": kv_backup_reuse,
    "kv_object_refs": lambda s, d: m.object_refs(_files(s, d).withColumn("size", F.col("size") % 3)),
    "kv_backup_purge": lambda s, d: m.purge(_files(s, d), 4),
    "kv_integrity_check": kv_integrity_check,
    "kv_verify_model": kv_verify_model,
    "kv_verify_ledger": kv_verify_ledger,
    "kv_value_check": kv_value_check,
    "kv_range_sizes": lambda s, d: m.range_sizes(_log(s, d), [(0, 50), (10, 100), (149, 9999), (20, 20)]),
    "kv_live_bytes": lambda s, d: m.live_bytes(visibility.visible(_log(s, d, True))),
    "kv_file_types": lambda s, d: m.file_types(s.read.parquet(f"{d}/orders.parquet").selectExpr(f"{FILE_NAME} AS name", f"{FILES['size']} AS size")),
    "kv_purge_objects": kv_purge_objects,
    "kv_orphan_objects": lambda s, d: m.orphan_objects(_objects(s, d).select("object_id").distinct(), _objects(s, d).where("backup_id > 6")),
    "kv_custom_order": kv_custom_order,
    "kv_limited_scan": kv_limited_scan,
    "kv_add_results": lambda s, d: visibility.add_results(_log(s, d)).select("key", "seq", "value"),
    "rep_rates": rep_rates,
    "rep_percentiles": lambda s, d: reports.summary(_values(s, d), "event_type", "value").select("event_type", "n", "min", "max", "p05", "p50", "p95"),
    "rep_histogram": lambda s, d: reports.histogram(_values(s, d), "event_type", "micros"),
    "rep_operation_stats": lambda s, d: reports.operation_stats(_values(s, d), "event_type", "micros", 10000).select("event_type", "n", F.round("total", 2).alias("total"), F.round("avg", 4).alias("avg"), "max", "slow"),
    "rep_fault_counts": lambda s, d: reports.fault_counts(_faults(s, d)),
    "rep_fault_statuses": lambda s, d: reports.status_counts(_faults(s, d)),
    "rep_rate_summaries": rep_rate_summaries,
    "rep_throughput_drop": lambda s, d: reports.summary(_values(s, d), "event_type", "value").select("event_type", F.round("drop", 9).alias("drop")),
    "rep_run_summary": rep_run_summary,
    "rep_reclamation": lambda s, d: reports.reclamation(_values(s, d).select(F.expr("CASE id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'backoff' ELSE 'none' END").alias("status"), F.floor("value").cast("long").alias("shrink_bytes"))),
    "rep_amplification": lambda s, d: _files(s, d).groupBy("cf_id").agg(reports.amplification(F.sum("size"), F.sum(F.when(F.col("level") > 0, F.col("size")))).alias("amplification")),
}

#: The same queries at the newest sequence number.
QUERIES |= {
    "kv_live_as_of_whole": kv_live_as_of_whole,
    "kv_live_swept_whole": lambda s, d: _plain(visibility.visible(_log(s, d), None, "sweep")),
    "kv_point_get_whole": lambda s, d: _plain(reads.get(_log(s, d), 149)),
    "kv_multi_get_whole": lambda s, d: reads.multi_get(_log(s, d), KEYS),
    "kv_scan_limit_whole": lambda s, d: _plain(reads.scan(_log(s, d), limit=20)),
    "kv_reverse_scan_whole": lambda s, d: _plain(reads.scan(_log(s, d), reverse=True)),
    "kv_seek_whole": lambda s, d: _plain(reads.seek(_log(s, d), 50)),
    "kv_seek_for_prev_whole": lambda s, d: _plain(reads.seek_for_prev(_log(s, d), 50)),
    "kv_range_scan_whole": lambda s, d: _plain(reads.scan(_log(s, d), low=20, high=90)),
    "kv_first_last_whole": lambda s, d: reads.first_last(_log(s, d, True)),
    "kv_counter_families_whole": lambda s, d: visibility.counters(_log(s, d, True)).select("cf_id", "key", "value"),
    "kv_counter_history_whole": lambda s, d: visibility.counter_history(_log(s, d)).select("key", "seq", "value"),
    "kv_cf_isolation_whole": lambda s, d: visibility.visible(_log(s, d, True)),
    "kv_snapshot_diff_whole": kv_snapshot_diff_whole,
    "kv_compact_survivors_whole": lambda s, d: _verdicts_whole(s, d).where("keep").select("key", "seq", "op"),
    "kv_compact_dropped_whole": kv_compact_dropped_whole,
    "kv_compact_live_whole": kv_compact_live_whole,
    "kv_verify_model_whole": kv_verify_model_whole,
}


def _log_sql(families: bool = False) -> str:
    columns = EVENT_COLUMNS | ({} if families else {"cf_id": "1"})
    return "log AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM events)"


def _visible_sql(seq: str | None = None, families: bool = False, name: str = "live") -> str:
    bound = "" if seq is None else f" AND seq <= {seq}"
    return f"""{name} AS (SELECT p.cf_id, p.key, p.seq, p.value FROM (
      SELECT *, row_number() OVER (PARTITION BY cf_id, key ORDER BY seq DESC) AS rn FROM log WHERE op IN (0, 1){bound}) p
    WHERE rn = 1 AND op = 1 AND NOT EXISTS (SELECT 1 FROM log t WHERE t.op = 2{bound.replace("seq", "t.seq")} AND t.cf_id = p.cf_id AND t.key <= p.key AND p.key < t.end_key AND t.seq > p.seq))"""


_TIP = "tip AS (SELECT max(seq) AS newest, max(seq) * 9 // 10 AS late, max(seq) * 4 // 9 AS early FROM log)"
LATE, EARLY = "(SELECT late FROM tip)", "(SELECT early FROM tip)"


def _live(select: str, seq: str | None = LATE, families: bool = False) -> str:
    return f"WITH {_log_sql(families)}, {_TIP}, {_visible_sql(seq, families)} {select}"


_ROWS = "SELECT key, seq, value FROM live"
_FILES = "files AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FILES.items()) + " FROM orders)"
_COUNTERS = """samples AS (SELECT user_id, event_id * 250 AS time_millis, CAST(sum(step) OVER w AS BIGINT) % 5000 AS operations, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN step ELSE 0 END) OVER w AS BIGINT) AS reads,
  CAST(sum(CASE WHEN event_type IN ('signup', 'purchase') THEN step ELSE 0 END) OVER w AS BIGINT) AS writes, CAST(sum(CASE WHEN event_type = 'error' THEN step ELSE 0 END) OVER w AS BIGINT) AS removes
  FROM (SELECT *, CAST(floor(value) AS BIGINT) AS step FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""
_VALUES = "vals AS (SELECT event_type, value, user_id, event_id AS id, value * 40 AS micros FROM events)"


def _kept_sql(seq: str) -> str:
    return f"""WITH {_log_sql()}, {_TIP}, own AS (SELECT *, lag(seq) OVER (PARTITION BY cf_id, key ORDER BY seq DESC) AS newer FROM log WHERE op != 3),
  verdicts AS (SELECT *, NOT (op != 2 AND (coalesce(newer <= {seq}, false) OR (op = 0 AND seq <= {seq}))) AS keep FROM own)"""


_KEPT, _KEPT_WHOLE = _kept_sql(LATE), _kept_sql("(SELECT newest FROM tip)")


def _counter_sql(seq: str | None, families: bool, columns: str) -> str:
    bound = "" if seq is None else f" WHERE seq <= {seq}"
    return f"""WITH {_log_sql(families)}, {_TIP}, own AS (SELECT * FROM log{bound}),
    keys AS (SELECT DISTINCT cf_id, key FROM own WHERE op != 2),
    resets AS (SELECT k.cf_id, k.key, max(o.seq) AS base, arg_max(o.op, o.seq) AS op, arg_max(coalesce(o.value, 0), o.seq) AS start FROM keys k LEFT JOIN own o
      ON o.cf_id = k.cf_id AND ((o.op IN (0, 1) AND o.key = k.key) OR (o.op = 2 AND o.key <= k.key AND k.key < o.end_key)) GROUP BY k.cf_id, k.key),
    sums AS (SELECT r.cf_id, r.key, coalesce(r.op = 1, false) AS has, CASE WHEN r.op = 1 THEN r.start ELSE 0 END AS start, sum(o.delta) AS added FROM resets r LEFT JOIN own o
      ON o.cf_id = r.cf_id AND o.key = r.key AND o.op = 3 AND o.seq > coalesce(r.base, -1) GROUP BY ALL)
    SELECT {columns}, CAST(start + coalesce(added, 0) AS BIGINT) AS value FROM sums WHERE has OR added IS NOT NULL"""


def _percentile(p: float, column: str = "value") -> str:
    return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"


_asked = ", ".join(f"({i}, {k})" for i, k in enumerate(KEYS))
ORACLES = {
    "kv_live_latest": _live(_ROWS, None),
    "kv_live_as_of": _live(_ROWS),
    "kv_live_swept": _live(_ROWS),
    "kv_point_get": _live(_ROWS + " WHERE key = 149"),
    "kv_multi_get": _live(f"SELECT CAST(a.place AS BIGINT) AS place, CAST(a.k AS BIGINT) AS key, value FROM (VALUES {_asked}) AS a(place, k) LEFT JOIN live ON live.key = a.k"),
    "kv_scan_limit": _live(_ROWS + " ORDER BY key LIMIT 20"),
    "kv_reverse_scan": _live(_ROWS + " ORDER BY key DESC"),
    "kv_seek": _live(_ROWS + " WHERE key >= 50 ORDER BY key LIMIT 1"),
    "kv_seek_for_prev": _live(_ROWS + " WHERE key <= 50 ORDER BY key DESC LIMIT 1"),
    "kv_range_scan": _live(_ROWS + " WHERE key >= 20 AND key < 90"),
    "kv_prefix_scan": "SELECT c_name AS key, c_custkey AS seq, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE starts_with(c_name, 'Customer#00000') AND c_custkey % 10 != 0",
    "kv_first_last": _live("SELECT cf_id, min(key) AS first_key, max(key) AS last_key, count(*) AS live_keys FROM live GROUP BY cf_id", LATE, True),
    "kv_delete_mask": f"WITH {_log_sql()} SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op IN (0, 1)) WHERE rn = 1",
    "kv_range_delete_mask": f"WITH {_log_sql()}, p AS (SELECT key, max(seq) AS seq FROM log WHERE op IN (0, 1) GROUP BY key) SELECT p.key, p.seq, max(t.seq) AS cover FROM p LEFT JOIN log t ON t.op = 2 AND t.key <= p.key AND p.key < t.end_key GROUP BY p.key, p.seq",
    "kv_counter_final": _counter_sql(None, False, "key"),
    "kv_counter_as_of": _counter_sql(LATE, True, "cf_id, key"),
    "kv_key_history": f"WITH {_log_sql()} SELECT seq, op, value, delta FROM log WHERE key = 3 AND op != 2",
    "kv_raw_scan": f"WITH {_log_sql(True)} SELECT key, seq, op FROM log WHERE cf_id = 2",
    "kv_snapshot_diff": f"""WITH {_log_sql()}, {_TIP}, {_visible_sql(EARLY, name="old")}, {_visible_sql(LATE, name="new")}
      SELECT coalesce(o.key, n.key) AS key, o.value AS old_value, n.value AS new_value, CASE WHEN o.seq IS NULL THEN 'added' WHEN n.seq IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM old o FULL JOIN new n ON o.key = n.key WHERE o.seq IS DISTINCT FROM n.seq""",
    "kv_cf_isolation": _live("SELECT cf_id, key, seq, value FROM live", LATE, True),
    "kv_batch_sequence": "SELECT l_orderkey AS batch_id, min(seq) AS first_seq, max(seq) AS last_seq FROM (SELECT l_orderkey, 1000 + row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem) GROUP BY l_orderkey",
    "kv_compact_survivors": _KEPT + " SELECT key, seq, CAST(op AS INTEGER) AS op FROM verdicts WHERE keep",
    "kv_compact_dropped": _KEPT + " SELECT CAST(op AS INTEGER) AS op, count(*) AS ops, count(*) FILTER (NOT keep) AS dropped FROM verdicts GROUP BY op",
    "kv_compact_live": _live(_ROWS, None),
    "kv_approx_size": f"WITH {_log_sql()} SELECT CAST(coalesce(sum(length(CAST(key AS VARCHAR)) + coalesce(length(CAST(value AS VARCHAR)), 0)), 0) AS BIGINT) AS bytes, count(*) AS ops FROM log WHERE key >= 10 AND key < 100",
    "kv_level_files": f"WITH {_FILES} SELECT cf_id, level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY cf_id, level",
    "kv_level_overlap": f"""WITH {_FILES} SELECT cf_id, level, CAST(max(bytes) AS BIGINT) AS overlap_bytes FROM (SELECT a.cf_id, a.level, a.file_no, sum(b.size) AS bytes FROM files a JOIN files b
      ON a.cf_id = b.cf_id AND b.level = a.level + 1 AND a.smallest_key <= b.largest_key AND b.smallest_key <= a.largest_key WHERE a.level >= 1 GROUP BY ALL) GROUP BY cf_id, level""",
    "kv_gc_obsolete": f"WITH {_FILES} SELECT file_no, size FROM files WHERE cf_id = 2",
    "kv_backup_reuse": f"""WITH {_FILES}, old AS (SELECT DISTINCT name, size - size % 7 AS size FROM files WHERE backup_id < 10), plan AS (SELECT f.size, o.name IS NOT NULL AS reused FROM files f LEFT JOIN old o ON f.name = o.name AND f.size = o.size WHERE backup_id = 10)
      SELECT reused, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM plan GROUP BY reused""",
    "kv_object_refs": f"WITH {_FILES} SELECT concat_ws('-', name, CAST(size % 3 AS VARCHAR), lower(to_hex(crc32))) AS object_id, count(DISTINCT backup_id) AS refs, min(backup_id) AS first_backup, max(backup_id) AS last_backup FROM files GROUP BY 1",
    "kv_backup_purge": f"WITH {_FILES} SELECT backup_id FROM (SELECT backup_id, row_number() OVER (ORDER BY backup_id DESC) AS rn FROM (SELECT DISTINCT backup_id FROM files)) WHERE rn > 4",
    "kv_integrity_check": f"""WITH {_FILES} SELECT file_no, 'missing file' AS problem FROM files WHERE file_no % 13 = 0 UNION ALL SELECT file_no, 'wrong size' FROM files WHERE file_no % 13 != 0 AND file_no % 17 = 0
      UNION ALL SELECT file_no, 'bounds out of order' FROM files WHERE smallest_key > largest_key UNION ALL SELECT file_no, 'unknown family' FROM files WHERE cf_id NOT IN (1, 2)""",
    "kv_verify_model": f"WITH {_log_sql()}, {_TIP}, {_visible_sql(LATE)}, model AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op IN (0, 1) AND seq <= {LATE}) WHERE rn = 1 AND op = 1) SELECT m.key, 'lost' AS problem FROM model m LEFT JOIN live l ON m.key = l.key WHERE l.key IS NULL",
    "rep_rates": f"WITH {_COUNTERS} SELECT user_id, time_millis, CAST(greatest(operations - lag(operations) OVER w, 0) AS DOUBLE) * 1000.0::DOUBLE / greatest(time_millis - lag(time_millis) OVER w, 1) AS rate FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY time_millis) QUALIFY lag(time_millis) OVER w IS NOT NULL",
    "rep_rate_summaries": f"""WITH {_COUNTERS}, own AS (SELECT concat(user_id, ':', unnest(['reads', 'writes', 'removes'])) AS series, time_millis, unnest([reads, writes, removes]) AS counter FROM samples),
      r AS (SELECT series, CAST(greatest(counter - lag(counter) OVER w, 0) AS DOUBLE) * 1000.0::DOUBLE / greatest(time_millis - lag(time_millis) OVER w, 1) AS rate FROM own WINDOW w AS (PARTITION BY series ORDER BY time_millis) QUALIFY lag(time_millis) OVER w IS NOT NULL)
      SELECT series, count(*) AS n, round(avg(rate), 6) AS avg, min(rate) AS min, max(rate) AS max, {_percentile(0.05, "rate")} AS p05, {_percentile(0.5, "rate")} AS p50, {_percentile(0.95, "rate")} AS p95 FROM r GROUP BY series""",
    "rep_percentiles": f"WITH {_VALUES} SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, {_percentile(0.05)} AS p05, {_percentile(0.5)} AS p50, {_percentile(0.95)} AS p95 FROM vals GROUP BY event_type",
    "rep_histogram": f"WITH {_VALUES} SELECT event_type, CASE WHEN micros <= 10 THEN '<=10' WHEN micros <= 100 THEN '<=100' WHEN micros <= 1000 THEN '<=1000' WHEN micros <= 10000 THEN '<=10000' ELSE '>10000' END AS bucket, count(*) AS n FROM vals GROUP BY 1, 2",
    "rep_operation_stats": f"WITH {_VALUES} SELECT event_type, count(*) AS n, round(sum(micros), 2) AS total, round(avg(micros), 4) AS avg, max(micros) AS max, count(*) FILTER (micros >= 10000) AS slow FROM vals GROUP BY event_type",
    "rep_fault_counts": "SELECT event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS recovered, count(*) FILTER (event_id % 5 IN (1, 2)) AS detected, count(*) FILTER (event_id % 5 = 3) AS unexpected FROM events GROUP BY event_type",
    "rep_fault_statuses": "SELECT CASE event_id % 5 WHEN 0 THEN 'RECOVERED' WHEN 1 THEN 'DETECTED' WHEN 2 THEN 'DETECTED_BY_VERIFY' WHEN 3 THEN 'UNEXPECTED_OPEN' ELSE 'SKIPPED' END AS status, count(*) AS n FROM events GROUP BY 1",
    "rep_throughput_drop": f"WITH {_VALUES}, q AS (SELECT event_type, {_percentile(0.05)} AS p05, {_percentile(0.5)} AS p50 FROM vals GROUP BY event_type) SELECT event_type, round(CASE WHEN p50 > 0 THEN greatest(0.0, 1 - p05 / p50) ELSE 0.0 END, 9) AS drop FROM q",
    "rep_run_summary": f"""WITH {_VALUES}, s AS (SELECT *, id % 9 + 1 AS span, row_number() OVER (PARTITION BY user_id ORDER BY id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM vals),
      w AS (SELECT *, CASE WHEN n > 2 THEN 2 ELSE n - 1 END AS warm FROM s),
      mid AS (SELECT user_id, list(span ORDER BY span)[count(*) // 2 + 1] AS middle FROM w WHERE i > warm AND i < n GROUP BY user_id),
      kept AS (SELECT w.* FROM w LEFT JOIN mid USING (user_id) WHERE i > warm AND NOT coalesce(i = n AND middle > 0 AND span * 2 < middle, false)),
      q AS (SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, {_percentile(0.05)} AS p05, {_percentile(0.5)} AS p50, {_percentile(0.95)} AS p95 FROM kept GROUP BY user_id)
      SELECT *, round(CASE WHEN p50 > 0 THEN greatest(0.0, 1 - p05 / p50) ELSE 0.0 END, 9) AS drop FROM q""",
    "rep_reclamation": "SELECT count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS success, count(*) FILTER (event_id % 3 = 1) AS backoff, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS shrink_bytes FROM events",
    "rep_amplification": f"WITH {_FILES} SELECT cf_id, CAST(sum(size) AS DOUBLE) / CAST(sum(size) FILTER (level > 0) AS DOUBLE) AS amplification FROM files GROUP BY cf_id",
}
_MODEL = "model AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM log WHERE op IN (0, 1)) WHERE rn = 1 AND op = 1)"
ORACLES |= {
    "kv_live_as_of_whole": f"WITH {_log_sql()}, {_TIP}, {_visible_sql(LATE)} {_ROWS}",
    "kv_live_swept_whole": _live(_ROWS, None),
    "kv_point_get_whole": _live(_ROWS + " WHERE key = 149", None),
    "kv_multi_get_whole": _live(f"SELECT CAST(a.place AS BIGINT) AS place, CAST(a.k AS BIGINT) AS key, value FROM (VALUES {_asked}) AS a(place, k) LEFT JOIN live ON live.key = a.k", None),
    "kv_scan_limit_whole": _live(_ROWS + " ORDER BY key LIMIT 20", None),
    "kv_reverse_scan_whole": _live(_ROWS + " ORDER BY key DESC", None),
    "kv_seek_whole": _live(_ROWS + " WHERE key >= 50 ORDER BY key LIMIT 1", None),
    "kv_seek_for_prev_whole": _live(_ROWS + " WHERE key <= 50 ORDER BY key DESC LIMIT 1", None),
    "kv_range_scan_whole": _live(_ROWS + " WHERE key >= 20 AND key < 90", None),
    "kv_first_last_whole": _live("SELECT cf_id, min(key) AS first_key, max(key) AS last_key, count(*) AS live_keys FROM live GROUP BY cf_id", None, True),
    "kv_counter_families_whole": _counter_sql(None, True, "cf_id, key"),
    "kv_counter_history_whole": f"""WITH {_log_sql()}, keys AS (SELECT DISTINCT key FROM log WHERE op != 2),
      ops AS (SELECT key, seq, op, coalesce(value, delta) AS v FROM log WHERE op != 2 UNION ALL SELECT k.key, t.seq, 0, NULL FROM keys k JOIN log t ON t.op = 2 AND t.key <= k.key AND k.key < t.end_key),
      cut AS (SELECT *, sum(CASE WHEN op != 3 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS segment FROM ops)
      SELECT key, seq, CASE WHEN max(CASE WHEN op != 0 THEN 1 ELSE 0 END) OVER w = 1 THEN CAST(sum(coalesce(v, 0)) OVER w AS BIGINT) END AS value FROM cut WINDOW w AS (PARTITION BY key, segment ORDER BY seq)""",
    "kv_cf_isolation_whole": _live("SELECT cf_id, key, seq, value FROM live", None, True),
    "kv_snapshot_diff_whole": f"""WITH {_log_sql()}, {_TIP}, {_visible_sql(EARLY, name="old")}, {_visible_sql(name="new")}
      SELECT coalesce(o.key, n.key) AS key, o.value AS old_value, n.value AS new_value, CASE WHEN o.seq IS NULL THEN 'added' WHEN n.seq IS NULL THEN 'removed' ELSE 'changed' END AS change
      FROM old o FULL JOIN new n ON o.key = n.key WHERE o.seq IS DISTINCT FROM n.seq""",
    "kv_compact_survivors_whole": _KEPT_WHOLE + " SELECT key, seq, CAST(op AS INTEGER) AS op FROM verdicts WHERE keep",
    "kv_compact_dropped_whole": _KEPT_WHOLE + " SELECT CAST(op AS INTEGER) AS op, count(*) AS ops, count(*) FILTER (NOT keep) AS dropped FROM verdicts GROUP BY op",
    "kv_compact_live_whole": _live(_ROWS, None),
    "kv_verify_model_whole": f"WITH {_log_sql()}, {_visible_sql()}, {_MODEL} SELECT m.key, 'lost' AS problem FROM model m LEFT JOIN live l ON m.key = l.key WHERE l.key IS NULL",
}
_SIZE_SQL = "length(CAST(key AS VARCHAR)) + coalesce(length(CAST(value AS VARCHAR)), 0)"
ORACLES |= {
    "kv_verify_ledger": f"""WITH {_log_sql()}, {_visible_sql()}, there AS (SELECT * FROM live WHERE seq % 11 != 0), {_MODEL}
      SELECT g.key, g.seq, CASE WHEN g.op = 1 AND t.seq IS NULL THEN 'lost' WHEN g.op = 1 THEN 'other version' ELSE 'removed key is live' END AS problem FROM (SELECT * FROM log WHERE op IN (0, 1)) g LEFT JOIN model m ON m.key = g.key LEFT JOIN there t ON t.key = g.key
      WHERE (g.op = 1 AND m.seq = g.seq AND t.seq IS DISTINCT FROM g.seq) OR (g.op = 0 AND m.key IS NULL AND t.key IS NOT NULL)""",
    "kv_value_check": "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'missing value' WHEN o_orderkey % 11 = 0 THEN 'value too small' WHEN o_orderkey % 7 = 0 THEN 'checksum mismatch' WHEN o_orderkey % 5 = 0 THEN 'value mismatch' END AS problem FROM orders) WHERE problem IS NOT NULL",
    "kv_range_sizes": f"WITH {_log_sql()}, asked AS (SELECT * FROM (VALUES (0, 0, 50), (1, 10, 100), (2, 149, 9999), (3, 20, 20)) AS a(place, low, high)) SELECT CAST(place AS BIGINT) AS place, CAST(coalesce(sum({_SIZE_SQL}), 0) AS BIGINT) AS bytes, count(key) AS ops FROM asked LEFT JOIN log ON key >= low AND key < high GROUP BY place",
    "kv_live_bytes": _live(f"SELECT cf_id, count(*) AS keys, CAST(sum({_SIZE_SQL}) AS BIGINT) AS bytes FROM live GROUP BY cf_id", None, True),
    "kv_file_types": f"SELECT CASE o_orderkey % 8 WHEN 0 THEN 'current' WHEN 1 THEN 'lock' WHEN 2 THEN 'info_log' WHEN 3 THEN 'manifest' WHEN 4 THEN 'log' WHEN 5 THEN 'table' ELSE 'temp' END AS type, count(*) AS files, CAST(sum({FILES['size']}) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 8 != 7 GROUP BY 1",
    "kv_purge_objects": f"WITH {_FILES}, o AS (SELECT concat_ws('-', name, CAST(size AS VARCHAR)) AS object_id, backup_id FROM files), old AS (SELECT DISTINCT backup_id FROM o ORDER BY backup_id DESC OFFSET 4) SELECT DISTINCT object_id FROM o WHERE backup_id IN (FROM old) AND object_id NOT IN (SELECT object_id FROM o WHERE backup_id NOT IN (FROM old))",
    "kv_orphan_objects": f"WITH {_FILES}, o AS (SELECT concat_ws('-', name, CAST(size AS VARCHAR)) AS object_id, backup_id FROM files) SELECT DISTINCT object_id FROM o WHERE object_id NOT IN (SELECT object_id FROM o WHERE backup_id > 6)",
    "kv_custom_order": "SELECT c_name AS key, c_custkey AS seq, CAST(c_nationkey AS BIGINT) AS value FROM customer WHERE c_custkey % 10 != 0 AND reverse(c_name) >= reverse('Customer#000000001') AND reverse(c_name) < reverse('Customer#000000005')",
}
ORACLES["kv_counter_history"] = ORACLES["kv_counter_history_whole"]
ORACLES["kv_limited_scan"] = "SELECT to_base64(encode(c_name)) AS key, to_base64(encode(CAST(c_nationkey AS VARCHAR))) AS value, (SELECT count(*) FROM customer WHERE c_custkey % 10 != 0) > 25 AS truncated FROM customer WHERE c_custkey % 10 != 0 ORDER BY c_name LIMIT 25"
ORACLES["kv_add_results"] = ORACLES["kv_counter_history_whole"].replace("SELECT key, seq, CASE WHEN max(", "SELECT key, seq, value FROM (SELECT key, seq, op, CASE WHEN max(").replace(" AS value FROM cut WINDOW", " AS value FROM cut WINDOW") + ") WHERE op = 3"
#: DuckDB's name of the text type, where a mapping's text is shared.
ORACLES = {k: v.replace("AS STRING)", "AS VARCHAR)") for k, v in ORACLES.items()}
