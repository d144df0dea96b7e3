"""Operator 5, URL filters, by a sort-merge range join, with DataFrame functions only.

A host is turned round, label by label, so that a host and its subdomains fill one interval of keys:
example.net becomes "net.example." and holds every key from there up to "net.example/" ('/' follows '.'). Intervals
nest or are apart. Each rule host sends two events, start and end, that carry the stack of rules active after them;
in a sort of urls and events together, the stack of a url is the last event's. The url's path then picks from it.

Urls are dealt to slices by a hash of the row, so no host, however frequent, fills a slice; the events go to every
slice, through the shuffle, where Spark can spill them. The sort and the sweep run in each slice.

Defined results: a null url, or one without "://", has an empty host and path and gets the default verdict; null ids,
repeated rows and extra columns pass through; null rule hosts fit nothing, null rule paths are empty; equal rules
count once, and where a host and path are both blocked and allowed, block holds; no rules: the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: The query's rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_substr(rest, F.lit(r"^[^/?#]+")), *LOWER)
    tail = F.regexp_replace(rest, r"^[^/?#]+", "")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_substr(tail, F.lit(r"^[^?#]+")), F.lit(""))


def host_key(host: Column) -> Column:
    """net.example. for example.net; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): starts and ends of the rules' hosts, with the rules active from there on, as (host, path, verdict)."""
    rules = rules.where("host is not null and host <> ''").groupBy("host", F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    keyed = rules.select(host_key(F.col("host")).alias("key"), F.struct("host", "path", "verdict").alias("rule"))
    hosts = keyed.select("key").distinct()
    labels = F.split("key", r"\.")  # the last is empty
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("up"))
    stacks = above.join(keyed.withColumnRenamed("key", "up"), "up").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("up", "rule"))).alias("all"))
    stacks = stacks.select("key", F.transform("all", lambda x: x["rule"]).alias("full"), F.transform(F.filter("all", lambda x: x["up"] != F.col("key")), lambda x: x["rule"]).alias("outer"))
    start = stacks.select("key", F.lit(1).alias("kind"), F.col("full").alias("stack"))
    # The interval ends before "net.example/"; kind 0 puts an end before a start of the same key.
    end = stacks.select(F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.lit(0).alias("kind"), F.col("outer").alias("stack"))
    return start.unionByName(end)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict to pages; its columns with these names are replaced. rules: host, path, verdict."""
    slices = partitions(pages.sparkSession)
    host, path = host_and_path(F.col(url_col).cast("string"))
    pages = pages.withColumns({"host": host, "path": path})
    kept = [c for c in pages.columns]
    urls = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), host_key(F.col("host")).alias("_key"), F.lit(2).alias("_kind"))
    urls = urls.withColumn("_slice", F.pmod(F.xxhash64("_row"), F.lit(slices)).cast("int"))
    found = events(rules).select(F.col("key").alias("_key"), F.col("kind").alias("_kind"), F.col("stack").alias("_stack"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    both = urls.unionByName(found, allowMissingColumns=True)
    sweep = Window.partitionBy("_slice").orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_active", F.last("_stack", ignorenulls=True).over(sweep)).where("_kind = 2")
    fits = F.filter("_active", lambda r: F.startswith(F.col("_row.path"), r["path"]))
    name = lambda r: F.concat(r["host"], r["path"])
    best = F.element_at(F.sort_array(F.transform(fits, lambda r: F.struct(F.length(name(r)).alias("n"), F.length(r["host"]).alias("m"), name(r).alias("rule"), r["verdict"].alias("verdict"))), asc=False), 1)
    swept = swept.withColumn("_best", F.when(F.size(fits) > 0, best))
    return swept.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept if c not in ("rule", "verdict")], F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filters(spark, sf_dir):
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL_OP5 = """
with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*'), '') as path from cut),
rules(rhost, rpath, rverdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
named as (
  select page_id, host, path,
    (select arg_max(struct_pack(r := rhost || rpath, v := rverdict), length(rhost || rpath)) from rules
     where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as best
  from parts)
select page_id, host, path, best.r as rule, coalesce(best.v, 'allow') as verdict from named
"""
