"""URL filters as a sort-merge range join over reversed-host keys, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

#: The contract's rules: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or no :// gives an empty host."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each ended by a dot: a host's subdomains are the keys that begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_marks(rules: DataFrame) -> DataFrame:
    """Where the sweep's stack changes: (key, kind, stack). kind 0 ends an interval, 1 begins one; stack holds the rules active from there on.

    Rules of one host form one interval [key, key with its last dot raised by one). Intervals nest or are apart. The stack of a host is its own rules and those
    of its parent hosts: one row per host and parent, so rules cost as many rows as their hosts have labels.
    """
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.struct("host", "path", "verdict"))).alias("own"))
    labels = F.split("host", r"\.")
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("parent"))
    stacks = parents.join(hosts.select(F.col("host").alias("parent"), "own"), "parent").groupBy("host").agg(F.flatten(F.collect_list("own")).alias("stack"))
    keyed = stacks.withColumn("key", host_key(F.col("host")))
    begin = keyed.select("key", F.lit(1).alias("kind"), "stack")
    # After an interval the nearest enclosing rule host's stack holds again: the rules of proper parents are in the stack already.
    end = keyed.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("kind"), F.filter("stack", lambda r: r["host"] != F.col("host")).alias("stack"))
    return begin.unionByName(end)


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", parts: int | None = None) -> DataFrame:
    """Judges rows (page_id, url) by rules (host, path, verdict).

    A rule fits its host and all subdomains if the url's path begins with the rule's; the longest host + path wins. A rule of an empty or null host is not used.
    Returns page_id, host, path, rule (host + path or null) and verdict (the rule's, else `default`).
    Null url or one without ://: empty host and path, no rule. Repeated rows and equal ids: each judged. Empty tables: no rows, or no rules. Other columns are not read.

    Urls and marks are sorted together by range; page_id and path are part of the sort key, so a host with a third of all pages spreads over many ranges. A range
    takes its first stack from the last mark of the ranges before it: one row per range.
    """
    spark = urls.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rule_marks(rules.where(F.coalesce(F.length("host"), F.lit(0)) > 0).select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict"))
    pages = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host"))).withColumn("kind", F.lit(2))
    both = pages.unionByName(marks, allowMissingColumns=True)
    order = [F.col("key"), F.col("kind"), F.col("path"), F.col("page_id")]
    swept = stored(both.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "url-sweep")

    last = F.max_by("stack", F.when(F.col("kind") < 2, F.struct("key", "kind")))
    carry = swept.groupBy("part").agg(last.alias("stack"))
    carried = carry.select("part", F.last("stack", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("from_before"))
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    active = swept.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2").join(carried, "part", "left")
    active = active.withColumn("active", F.coalesce("active", "from_before"))
    fitting = F.filter(F.coalesce("active", F.array().cast("array<struct<host:string,path:string,verdict:string>>")), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["host"]).alias("hosts"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return active.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(host, path, verdict)"))


OP7_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(r, ''), '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(h, p, v)),
fit AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h) + length(p) DESC, length(h) DESC) AS rn
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT a.page_id, a.host, a.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts a LEFT JOIN (SELECT DISTINCT page_id, host, path, rule, v FROM fit WHERE rn = 1) f ON a.page_id IS NOT DISTINCT FROM f.page_id AND a.host = f.host AND a.path = f.path
"""
