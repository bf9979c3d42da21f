"""URL rules by a sort-merge range join over reversed-host keys, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's.
The key of a rule is its reversed host, a separator and its path; every url the rule fits has, for one
of the suffixes of its host, a key that starts with the rule's key, so the rule is the interval
[key, key + 0xFF) of UTF-8 bytes (0xFF is no byte of UTF-8). Intervals of prefixes nest or are apart.
Rule starts, rule ends and url keys are sorted together; the sweep holds a stack of active rules: the
depth is a running sum of +1 and -1, the rule at each depth the last one started at that depth.
The sort is by range over (key, page), so that equal keys of a very common host spread over tasks;
each range gets the stack it starts with from the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import partitions, table, written

#: (host, path, verdict)
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\u0001"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules or [(None, None, None)], "rule_host string, rule_path string, rule_verdict string").filter("rule_host is not null")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host || path, null if none fits), verdict for every row of pages.

    pages: page_id, url; other columns are ignored. rules: rule_host, rule_path, rule_verdict. The
    longest fitting rule (most characters of host and path) wins. Null and malformed urls have an empty
    host and path, fit no rule and get `default`, as do all urls if there are no rules. Repeated rows
    give repeated rows; a null page_id is kept. Repeated rules count once, the smallest verdict wins.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    pages = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # one row for each suffix of the host, the whole host first
    labels = F.split("host", r"\.")
    keyed = pages.select("page_id", "host", "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: reversed_host(F.slice(labels, i, F.size(labels))))).alias("level", "suffix"))
    urls = keyed.select(
        F.concat(F.col("suffix"), F.lit(SEPARATOR), F.col("path")).cast("binary").alias("key"),
        F.lit(2).alias("kind"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict"),
        "page_id", "host", "path", "level",
    )
    own = rules.groupBy("rule_host", "rule_path").agg(F.min("rule_verdict").alias("rule_verdict"))
    start = F.concat(reversed_host(F.split("rule_host", r"\.")), F.lit(SEPARATOR), F.col("rule_path")).cast("binary")
    blank = [F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("level")]
    name = F.concat("rule_host", "rule_path").alias("rule")
    starts = own.select(start.alias("key"), F.lit(1).alias("kind"), name, "rule_verdict", *blank)
    ends = own.select(F.concat(start, F.lit(bytearray(b"\xff"))).alias("key"), F.lit(0).alias("kind"), name, "rule_verdict", *blank)
    events = starts.unionByName(ends).unionByName(urls)
    events = events.repartitionByRange(partitions(spark), "key", "kind", "page_id").withColumn("range", F.spark_partition_id())
    events = written(events, "url-events")

    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)
    in_range = Window.partitionBy("range").orderBy("key", "kind", "page_id").rowsBetween(Window.unboundedPreceding, 0)
    # the rules alone: how deep they nest, and the stack with which each range begins
    bounds = events.filter("kind < 2").select("range", "key", "kind", "rule", "rule_verdict", "page_id")
    ranges = events.select("range").distinct()
    moved = bounds.groupBy("range").agg(F.sum(step).alias("moved"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    depths = ranges.join(moved, "range", "left").select("range", F.coalesce(F.sum("moved").over(before), F.lit(0)).alias("depth_in"))
    depths = written(depths, "url-depths")
    deep = bounds.join(depths, "range").withColumn("depth", F.col("depth_in") + F.sum(step).over(in_range))
    most = deep.agg(F.max("depth")).head()[0] or 0
    top = lambda d: F.when((F.col("kind") == 1) & (F.col("depth") == d), F.struct("rule", "rule_verdict"))
    carry = depths
    if most:
        opened = deep.groupBy("range").agg(*[F.max(F.when(top(d).isNotNull(), F.struct("key", "rule", "rule_verdict"))).alias(f"opened{d}") for d in range(1, most + 1)])
        carry = depths.join(opened, "range", "left").select("range", "depth_in", *[F.last(f"opened{d}", ignorenulls=True).over(before).alias(f"in{d}") for d in range(1, most + 1)])
    swept = events.join(carry, "range").withColumn("depth", F.col("depth_in") + F.sum(step).over(in_range))
    if most:
        stack = [F.coalesce(F.last(top(d), ignorenulls=True).over(in_range), F.struct(F.col(f"in{d}.rule").alias("rule"), F.col(f"in{d}.rule_verdict").alias("rule_verdict"))) for d in range(1, most + 1)]
        swept = swept.withColumn("stack", F.array(*stack)).withColumn("hit", F.when(F.col("depth") > 0, F.element_at("stack", F.when(F.col("depth") > 0, F.col("depth").cast("int")).otherwise(1))))
    else:
        swept = swept.withColumn("hit", F.lit(None).cast("struct<rule:string,rule_verdict:string>"))
    best = F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length("hit.rule").alias("n"), F.col("hit.rule").alias("rule"), F.col("hit.rule_verdict").alias("verdict")))).alias("best")
    judged = swept.filter("kind = 2").groupBy("page_id", "host", "path").agg(best, F.count_if(F.col("level") == 0).alias("rows"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


QUERIES = {"op7_url_rules": op7_url_rules}
_REST = "substr(url, instr(url, '://') + 3)"
_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " + "{" + str(i) + "}" for i, (h, p, _) in sorted(enumerate(RULES), key=lambda x: -len(x[1][0] + x[1][1])))
ORACLES = {
    "op7_url_rules": f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN {_REST} ELSE '' END AS rest FROM pages),
    parts AS (
      SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
    SELECT page_id, host, path, CASE {_FITS.format(*[f"'{h}{p}'" for h, p, _ in RULES])} END AS rule,
           CASE {_FITS.format(*[f"'{v}'" for _, _, v in RULES])} ELSE 'allow' END AS verdict
    FROM parts
    """
}
