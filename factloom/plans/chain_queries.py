"""Chains and pairs: provenance on bucketed tables, missing variants, two sides of a product, first facts of a path."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import facts as X
from factloom.operators import provenance as O
from factloom.operators import resolve as R
from factloom.plans.register import query
from factloom.sources.store import payload_diffs
from factloom.sources.tables import table


def chain_tables(spark, sf_dir):
    """Line items as facts, orders as fact sets and diffs, customers as runs, nations as artifacts."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.when(F.col("l_suppkey") % 3 == 0, "title").when(F.col("l_suppkey") % 3 == 1, "base_price").otherwise("colour")
    return {
        "diffs": orders.filter("o_orderstatus <> 'P'").select((F.col("o_orderkey") * 2 + 1).alias("diff"), F.col("o_orderkey").alias("fact_set")),
        "fact_sets": orders.select(F.col("o_orderkey").alias("fact_set"), F.col("o_custkey").alias("run")),
        "facts": items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), F.col("l_orderkey").alias("fact_set"), key.alias("raw_key"), X.core_field(key).alias("canonical_key"), F.round(F.col("l_quantity") / 100, 2).alias("confidence")),
        "runs": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("artifact"), F.col("c_mktsegment").alias("extractor")),
        "artifacts": table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("artifact"), F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".test/p")).alias("url")),
    }


@query(
    "provenance_chain",
    """
    SELECT o_orderkey * 2 + 1 AS diff, l_orderkey * 10 + l_linenumber AS fact, CASE l_suppkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'base_price' ELSE 'colour' END AS raw_key,
           CASE l_suppkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'basePrice' END AS canonical_key, round(l_quantity / 100, 2) AS confidence, c_mktsegment AS extractor, 'https://' || lower(n_name) || '.test/p' AS url
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P'
    """,
)
def provenance_chain(spark, sf_dir):
    """All five tables of the chain, for all diffs; tests take one diff and look at the plan."""
    t = chain_tables(spark, sf_dir)
    origin = t["runs"].join(t["artifacts"], "artifact").select("run", "extractor", "url")
    joined = t["diffs"].join(t["fact_sets"], "fact_set").join(t["facts"], "fact_set").join(origin, "run")
    return joined.select("diff", "fact", "raw_key", "canonical_key", "confidence", "extractor", "url")


@query(
    "variant_missing",
    """
    WITH v AS (SELECT p_brand AS brand, p_type AS type, CASE WHEN p_size % 11 > 0 THEN p_size % 23 END AS size FROM part),
    g AS (SELECT brand, count(*) AS actual, count(DISTINCT type) * count(DISTINCT size) AS every FROM v GROUP BY brand),
    c AS (SELECT * FROM (SELECT DISTINCT brand, type FROM v WHERE type IS NOT NULL) JOIN (SELECT DISTINCT brand, size FROM v WHERE size IS NOT NULL) USING (brand)),
    m AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY type, size) AS nth FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.brand = c.brand AND v.type = c.type AND v.size = c.size))
    SELECT brand, type, size FROM m JOIN g USING (brand) WHERE nth <= greatest(0, every - actual)
    """,
)
def variant_missing(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.when(F.col("p_size") % 11 > 0, F.col("p_size") % 23).alias("size"))
    return R.missing_variants(parts, ["brand"], ["type", "size"])


@query(
    "reconcile_pairs",
    """
    WITH a AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_suppkey % 4 > 0 THEN l_quantity::INT::VARCHAR END AS value, (l_partkey % 3) / 10 AS c, l_shipdate AS ts FROM lineitem WHERE l_linenumber <> 2),
    b AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_suppkey % 5 > 0 THEN l_partkey::VARCHAR END AS value, (l_suppkey % 3) / 10 AS c, o_orderdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 3),
    w AS (SELECT o, n, a.value AS av, b.value AS bv, CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'neither' WHEN a.value IS NULL THEN 'b' WHEN b.value IS NULL THEN 'a' WHEN a.c > b.c OR (a.c = b.c AND a.ts >= b.ts) THEN 'a' ELSE 'b' END AS attribution FROM a FULL JOIN b USING (o, n))
    SELECT o AS product, n AS field, CASE attribution WHEN 'a' THEN av ELSE bv END AS value, attribution FROM w
    """,
)
def reconcile_pairs(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    row = lambda df, value, c, ts: df.select(F.col("l_orderkey").alias("product"), F.col("l_linenumber").alias("field"), value.alias("value"), (c / 10).alias("confidence"), F.col(ts).alias("ts"))
    a = row(items.filter("l_linenumber <> 2"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity").cast("int").cast("string")), F.col("l_partkey") % 3, "l_shipdate")
    b = row(items.filter("l_linenumber <> 3").join(orders, "l_orderkey"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_partkey").cast("string")), F.col("l_suppkey") % 3, "o_orderdate")
    return R.reconcile_pairs(a, b, ["product", "field"])


@query(
    "first_facts",
    """
    WITH f AS (SELECT l_orderkey AS page, CASE l_suppkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'mpn' WHEN 2 THEN 'colour' ELSE 'price' END AS raw_key,
                 CASE l_suppkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'modelNumber' WHEN 3 THEN 'basePrice' END AS canonical_key, round(l_quantity / 60, 2) AS confidence, l_linenumber FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY page, canonical_key, raw_key ORDER BY confidence DESC, l_linenumber) AS nth FROM f)
    SELECT page, raw_key, canonical_key, confidence, canonical_key IS NOT NULL AND confidence >= 0.85 AS approved, row_number() OVER (PARTITION BY page ORDER BY canonical_key IS NULL, coalesce(canonical_key, raw_key)) AS place FROM b WHERE nth = 1
    """,
)
def first_facts(spark, sf_dir):
    """Facts without a mapping take their core field, and of each path the best one stays."""
    key = F.when(F.col("l_suppkey") % 4 == 0, "title").when(F.col("l_suppkey") % 4 == 1, "mpn").when(F.col("l_suppkey") % 4 == 2, "colour").otherwise("price")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), key.alias("raw_key"), F.round(F.col("l_quantity") / 60, 2).alias("confidence"), F.col("l_linenumber").alias("ordinal"), none("string", "canonical_key"), none("string", "method"), none("array<struct<key:string,score:double>>", "candidates"), F.lit(False).alias("approved"))
    return X.first_fact_per_path(X.with_core_fallback(facts), ["page"]).select("page", "raw_key", "canonical_key", "confidence", "approved", "place")


@query(
    "payload_diffs",
    """
    WITH p AS (SELECT p_partkey AS diff, p_name AS title, CASE WHEN p_size > 10 THEN p_brand END AS brand, p_retailprice AS price FROM part),
    c AS (SELECT ps AS diff, max(c) AS c FROM (SELECT l_partkey AS ps, l_discount * 10 AS c FROM lineitem WHERE l_linenumber = 1) GROUP BY ps),
    r AS (
      SELECT diff, 'title' AS field, title AS value, c FROM p LEFT JOIN c USING (diff)
      UNION ALL SELECT diff, 'brand', brand, NULL FROM p WHERE brand IS NOT NULL
      UNION ALL SELECT diff, 'attributes', '{"n":' || (diff % 5) || '}', NULL FROM p)
    SELECT diff, field, value, coalesce(c, 0.6)::DOUBLE AS confidence, coalesce(c, 0.6) >= 0.9 AS auto FROM r
    """,
)
def payload_diffs_query(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    payloads = part.select(F.col("p_partkey").alias("diff"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("brand"), F.struct((F.col("p_partkey") % 5).alias("n")).alias("attributes"), F.lit(1).alias("internal"))
    facts = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_partkey").alias("diff"), F.lit(None).cast("string").alias("canonical_key"), F.lit("title").alias("raw_key"), (F.col("l_discount") * 10).alias("confidence"))
    return payload_diffs(payloads, facts, "diff")
