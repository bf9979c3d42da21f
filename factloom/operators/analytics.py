"""Scheduled analytics: aggregates over versions, events, runs and facts. `as_of` stands for the present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(ts: str, as_of: str, days: float) -> Column:
    """Rows of the last `days` before as_of."""
    return F.col(ts) > F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '{int(days * 24)}' HOUR")


def bucket(unit: str, ts: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def fleet_overview(versions: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per tenant, category and hour: versions, mean confidence without zeros, versions with attributes."""
    recent = versions.filter(since("created_at", as_of, days))
    return recent.groupBy("tenant", "category", bucket("hour", "created_at").alias("hour")).agg(
        F.count("*").alias("n"), F.avg(F.nullif("confidence", F.lit(0.0))).alias("avg_confidence"), F.count_if(F.col("attributes") != "{}").alias("with_attributes")
    )


def domain_health(events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Per domain, parser and hour: selectors fired and successes."""
    recent = events.filter(since("ts", as_of, days))
    return recent.groupBy("domain", "parser", bucket("hour", "ts").alias("hour")).agg(F.count("*").alias("fired"), F.count_if("success").alias("success"))


def field_completeness(rows: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Rows and non-empty values of each field per group."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f"with_{f}") for f in fields]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *filled)


def parser_versions(runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    recent = runs.filter(since("created_at", as_of, days))
    return recent.groupBy("extractor", "mapper", "policy", bucket("day", "created_at").alias("day")).agg(F.count("*").alias("n"))


def cost_panel(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Per tenant and day: sums of cost and tokens of the calls; what is missing counts as 0."""
    recent = events.filter(since("ts", as_of, days))
    total = lambda c: F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return recent.groupBy("tenant", bucket("day", "ts").alias("day")).agg(F.round(total("cost"), 6).alias("cost"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), F.count("*").alias("calls"))


def price_counts(prices: DataFrame, by: list[str], price: str = "price") -> DataFrame:
    """by, price, c: how often each price of a group is observed; combined before the shuffle."""
    return prices.groupBy(*by, price).agg(F.count("*").alias("c"))


def price_clusters(prices: DataFrame, by: list[str], price: str = "price", least: int = 10) -> DataFrame:
    """Exact median price and number of observations of groups of at least `least`; null prices count, but have no rank.

    Prices are counted first, and the median is found by running counts over a group's distinct prices in order, which
    spill to disk: no group is held in memory as a whole.
    """
    return clusters_of_counts(price_counts(prices, by, price), by, price, least)


def clusters_of_counts(counts: DataFrame, by: list[str], price: str = "price", least: int = 10) -> DataFrame:
    """price_clusters, of price_counts."""
    whole = Window.partitionBy(*by)
    valued = F.when(F.col(price).isNotNull(), F.col("c")).otherwise(0)
    run = counts.withColumn("_upto", F.sum(valued).over(whole.orderBy(price).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum(valued).over(whole)).withColumn("n", F.sum("c").over(whole))
    holds = lambda place: F.col(price).isNotNull() & (F.col("_upto") > place) & (F.col("_upto") - F.col("c") <= place)
    low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
    ends = run.filter("n >= " + str(int(least))).groupBy(*by).agg(F.max(F.when(holds(low), F.col(price))).alias("_low"), F.max(F.when(holds(high), F.col(price))).alias("_high"), F.max("n").alias("n"))
    return ends.select(*by, F.round((F.col("_low") + F.col("_high")) / 2, 6).alias("median_price"), "n")


def domain_profile(runs: DataFrame) -> DataFrame:
    """Per domain: runs, share of model runs, mean confidence; runs has domain, extractor, confidence."""
    return runs.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.avg(F.col("extractor").ilike("%llm%").cast("int")), 9).alias("llm_share"), F.round(F.avg("confidence"), 9).alias("avg_confidence"))


def failure_rollup(failures: DataFrame) -> DataFrame:
    """One row for each (tenant, domain, reason, raw_key or empty): first and last seen, occurrences, least id."""
    keyed = failures.withColumn("raw_key", F.coalesce("raw_key", F.lit("")))
    return keyed.groupBy("tenant", "domain", "reason", "raw_key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").cast("long").alias("occurrences"), F.min("id").alias("id"))


def keep_rolled_up(failures: DataFrame, rollup: DataFrame) -> DataFrame:
    """Rows whose id a rollup doesn't name, which it replaces."""
    return failures.join(rollup.select("id"), "id", "left_anti")


def override_eligible(overrides: DataFrame, as_of: str, least_usage: int = 10, idle_days: int = 30, least_tenants: int = 3) -> DataFrame:
    """Overrides in use often enough, idle for long enough, of keys that enough tenants share, not yet flagged."""
    shared = overrides.groupBy("source_key").agg(F.countDistinct("tenant").alias("tenants")).filter(F.col("tenants") >= least_tenants)
    idle = F.col("last_used").isNull() | ~since("last_used", as_of, idle_days)
    return overrides.filter((F.col("usage") >= least_usage) & idle & ~F.col("flagged")).join(shared.select("source_key"), "source_key", "left_semi")


def schema_promotion(products: DataFrame, authoritative: DataFrame, least_products: int = 50, least_keys: int = 8, share: float = 0.8) -> DataFrame:
    """Draft schemas of categories without an authoritative one: enough products with enough common keys.

    products: category, attributes (JSON object text). A draft lists the keys that at least `share` of the
    category's products have, and is inactive.
    """
    sizes = products.groupBy("category").agg(F.count("*").alias("products")).filter(F.col("products") >= least_products)
    keys = products.select("category", F.explode(F.json_object_keys("attributes")).alias("key")).groupBy("category", "key").agg(F.count("*").alias("n"))
    common = keys.join(sizes, "category").filter(F.col("n") >= share * F.col("products"))
    drafts = common.groupBy("category").agg(F.first("products").alias("products"), F.sort_array(F.collect_list("key")).alias("keys")).filter(F.size("keys") >= least_keys)
    properties = F.map_from_entries(F.transform("keys", lambda k: F.struct(k.alias("key"), F.struct(F.lit("string").alias("type")).alias("value"))))
    drafts = drafts.withColumn("draft", F.to_json(F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.col("keys").alias("required")))).withColumn("active", F.lit(False))
    return drafts.join(authoritative.select("category"), "category", "left_anti")


def open_clusters(tasks: DataFrame) -> DataFrame:
    """Open review tasks per cluster key, signal and severity, the latest first."""
    return tasks.filter("status = 'open'").groupBy("cluster_key", "signal", "severity").agg(F.count("*").alias("n"), F.max("updated_at").alias("latest")).orderBy(F.desc("latest"), "cluster_key", "signal", "severity")


def null_rates(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, total, nulls, rate: null or empty values; an empty cohort has rate 0."""
    empty = lambda f: F.col(f).isNull() | (F.col(f).cast("string") == "")
    counts = rows.agg(F.count("*").alias("total"), *[F.count_if(empty(f)).alias(f"n_{f}") for f in fields])
    long = counts.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("nulls")) for f in fields])).alias("x"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("x.nulls") / F.col("total"))
    return long.select("x.field", "total", "x.nulls", rate.alias("rate"))


def null_rate_drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """field, baseline, current, delta, drifted (in either direction); a field without a baseline had 0."""
    b = baseline.select("field", F.col("rate").alias("baseline"))
    out = current.select("field", F.col("rate").alias("current")).join(b, "field", "left").withColumn("baseline", F.coalesce("baseline", F.lit(0.0)))
    out = out.withColumn("delta", F.round(F.col("current") - F.col("baseline"), 9))
    return out.withColumn("drifted", F.abs("delta") >= threshold)


def psi(baseline: DataFrame, current: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Population stability index of a label's two distributions, and its band; 0 if a cohort is empty.

    Shares are at least 1e-4, so labels of one cohort only have a part.
    """
    by = by or []
    count = lambda df, name: df.groupBy(*by, label).agg(F.count("*").alias(name))
    both = count(baseline, "b").join(count(current, "c"), [*by, label], "full").fillna(0, ["b", "c"])
    totals = [F.sum("b").alias("nb"), F.sum("c").alias("nc")]
    if by:
        whole = Window.partitionBy(*by)
        shares = both.withColumn("nb", F.sum("b").over(whole)).withColumn("nc", F.sum("c").over(whole))
    else:
        shares = both.crossJoin(F.broadcast(both.agg(*totals)))  # one row
    p, q = F.greatest(F.lit(1e-4), F.col("b") / F.col("nb")), F.greatest(F.lit(1e-4), F.col("c") / F.col("nc"))
    part = F.when((F.col("nb") > 0) & (F.col("nc") > 0), (q - p) * F.ln(q / p)).otherwise(0.0)
    out = shares.withColumn("part", part).groupBy(*by).agg(F.round(F.sum("part"), 9).alias("psi"))
    return out.withColumn("band", psi_band(F.col("psi")))


def psi_band(c: Column) -> Column:
    return F.when(c < 0.1, "none").when(c < 0.25, "moderate").otherwise("significant")


def schema_drift(baseline: DataFrame, current: DataFrame, keys: str = "keys", often: float = 0.2, rare: float = 0.02) -> DataFrame:
    """Keys that are new or have vanished: often in one cohort and rare in the other; keys is an array column."""

    def freq(df: DataFrame, name: str) -> DataFrame:
        n = df.agg(F.count("*").alias("total"))
        return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("key", (F.col("n") / F.col("total")).alias(name))

    both = freq(baseline, "baseline").join(freq(current, "current"), "key", "full").fillna(0.0, ["baseline", "current"])
    change = F.when((F.col("current") >= often) & (F.col("baseline") < rare), "new").when((F.col("baseline") >= often) & (F.col("current") < rare), "vanished")
    return both.withColumn("change", change).filter("change IS NOT NULL")


def newest(rows: DataFrame, by: list[str], order: list[Column], most: int = 500) -> DataFrame:
    """The newest rows of each group."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def drift_scan(rows: DataFrame, fields: list[str], as_of: str, days: int = 7, most: int = 500, threshold: float = 0.1) -> DataFrame:
    """Null-rate drift of each category between the last days and before, over bounded cohorts of the newest rows.

    Categories without rows on one side are left out.
    """
    side = rows.withColumn("is_current", since("created_at", as_of, days))
    cohort = newest(side, ["category", "is_current"], [F.desc("created_at"), F.col("id")], most)
    empty = lambda f: F.col(f).isNull() | (F.col(f).cast("string") == "")
    rate = lambda f, now: F.avg(F.when(F.col("is_current") == now, empty(f).cast("int")))
    both = cohort.groupBy("category").agg(F.count_if("is_current").alias("n_current"), F.count_if(~F.col("is_current")).alias("n_baseline"), *[F.struct(F.lit(f).alias("field"), rate(f, F.lit(False)).alias("baseline"), rate(f, F.lit(True)).alias("current")).alias(f"s_{f}") for f in fields])
    long = both.filter("n_current > 0 AND n_baseline > 0").select("category", F.explode(F.array(*[f"s_{f}" for f in fields])).alias("s")).select("category", "s.*")
    delta = F.round(F.col("current") - F.col("baseline"), 9)
    return long.withColumn("delta", delta).withColumn("drifted", F.abs(delta) >= threshold)


def canary(pages: DataFrame, expected: DataFrame, most: int = 5) -> DataFrame:
    """Per retailer: its first pages, those with all expected fields, and the pass rate.

    pages: retailer, ordinal, fields (array); expected: retailer, wanted (array). No page: rate 1.
    """
    first = newest(pages, ["retailer"], [F.col("ordinal")], most).join(expected, "retailer", "right")
    passed = F.count_if(F.col("fields").isNotNull() & (F.size(F.array_except("wanted", "fields")) == 0))
    out = first.groupBy("retailer").agg(F.count("fields").alias("sampled"), passed.alias("passed"))
    return out.withColumn("pass_rate", F.when(F.col("sampled") == 0, 1.0).otherwise(F.col("passed") / F.col("sampled")))


def slo_burn(events: DataFrame, ok: Column, as_of: str, days: int = 28, budget: float = 0.1) -> DataFrame:
    """Share of failures over the error budget."""
    failed = F.avg((~ok).cast("int"))
    return events.filter(since("ts", as_of, days)).agg(F.count("*").alias("n"), F.round(F.coalesce(failed, F.lit(0.0)) / budget, 9).alias("burn"))


def shadow_compare(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, compared, different of two versions of the same rows; nulls equal nulls."""
    both = old.alias("o").join(new.alias("n"), key)
    diff = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))).cast("int").alias("different")) for f in fields])
    return both.select(F.explode(diff).alias("d")).groupBy("d.field").agg(F.count("*").alias("compared"), F.sum("d.different").cast("long").alias("different"))


def shadow_fields(both: DataFrame, old: str, new: str, fields: list[str], maps: list[str]) -> DataFrame:
    """both with differing (names of fields that differ, of maps field.key) and diff_ratio: their number over that of the
    fields compared. old and new are structs; keys of maps count one by one, so the ratio may exceed 1."""
    o, n = F.col(old), F.col(new)
    plain = [F.when(~o[f].eqNullSafe(n[f]), f) for f in fields]
    keys = lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
    at = lambda m, k: F.try_element_at(m, k)

    def inner(m: str) -> Column:
        unlike = F.filter(F.array_sort(F.array_union(keys(o[m]), keys(n[m]))), lambda k: ~at(o[m], k).eqNullSafe(at(n[m], k)))
        return F.transform(unlike, lambda k: F.concat(F.lit(f"{m}."), k))

    differing = F.concat(F.array_compact(F.array(*plain)), *[inner(m) for m in maps])
    return both.withColumn("differing", differing).withColumn("diff_ratio", F.size("differing") / (len(fields) + len(maps)))


def shadow_rate(events: DataFrame, as_of: Column) -> DataFrame:
    """field, n: differences of the last seven days, from events (ts, event_type, metadata) that name a field."""
    rows = events.filter((F.col("event_type") == "shadow.diff_detected") & (F.col("ts") > as_of - F.expr("INTERVAL 7 DAYS")))
    return rows.groupBy(F.get_json_object("metadata", "$.field").alias("field")).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return newest(rows, by, order, 1)
