"""Scheduled analytics on the tables: orders are runs and versions, events the audit stream, parts products."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import analytics as A
from factloom.operators import calibration as C
from factloom.operators import views as W
from factloom.plans.register import query
from factloom.sources.tables import dealt, shared_path, table

EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"


def prices(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    return items.join(parts, "l_partkey")


def part_price_counts(spark, sf_dir):
    """brand, category, price, c: lines are counted by part and price before they meet the parts, all dealt by part first."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))
    return A.price_counts(dealt(items, "l_partkey"), ["l_partkey"]).join(parts.hint("merge"), "l_partkey").groupBy("brand", "category", "price").agg(F.sum("c").alias("c"))


@query(
    "price_clusters",
    """
    SELECT p_brand AS brand, p_type AS category,
           round(quantile_cont(l_extendedprice / l_quantity, 0.5), 6) AS median_price, count(*) AS n
    FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY p_brand, p_type HAVING count(*) >= 10
    """,
)
def price_clusters(spark, sf_dir):
    return A.clusters_of_counts(part_price_counts(spark, sf_dir), ["brand", "category"])


@query(
    "view_refresh",
    """
    WITH p AS (SELECT p_brand AS brand, p_type AS category, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber = 2))
    SELECT brand, category, round(quantile_cont(price, 0.5), 6) AS median_price, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 10
    """,
)
def view_refresh(spark, sf_dir):
    """Price clusters kept up over three batches of orders; of the first, lines are withdrawn with the last."""
    view, folder = W.price_clusters(["brand", "category"]), shared_path(spark, "view")
    items = prices(spark, sf_dir)
    for i in range(3):
        came = items.filter(F.col("l_orderkey") % 3 == i).withColumn("change", F.lit(1))
        if i == 2:
            came = came.unionByName(items.filter("l_orderkey % 3 = 0 and l_linenumber = 2").withColumn("change", F.lit(-1)))
        W.refresh(view, folder, came, i)
    return W.shown(view, spark, folder, ORDERS_AS_OF)


@query(
    "price_anomaly",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, p_brand AS brand, p_type AS category, l_extendedprice / l_quantity AS price
               FROM lineitem JOIN part ON l_partkey = p_partkey),
         c AS (SELECT brand, category, round(quantile_cont(price, 0.5), 6) AS median_price FROM p GROUP BY brand, category HAVING count(*) >= 10)
    SELECT brand, category, count(*) AS n,
           count(*) FILTER (price > 1.4 * median_price OR price < 0.7 * median_price) AS anomalies
    FROM p JOIN c USING (brand, category) GROUP BY brand, category
    """,
)
def price_anomaly(spark, sf_dir):
    """Observations far from their cluster's median; the bounds are parameters, here narrow enough for these tables."""
    from factloom.operators.policy import price_is_odd

    by = ["brand", "category"]
    counts = part_price_counts(spark, sf_dir)
    known = counts.join(A.clusters_of_counts(counts, by).withColumnRenamed("n", "samples"), by)
    odd = price_is_odd(F.col("price"), F.col("median_price"), F.col("samples"), 1.4, 0.7)
    return known.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.coalesce(odd, F.lit(False)), F.col("c")).otherwise(0)).alias("anomalies"))


@query(
    "fleet_overview",
    f"""
    SELECT o_orderpriority AS tenant, o_orderstatus AS category, date_trunc('hour', o_orderdate)::TIMESTAMP AS hour, count(*) AS n,
           avg(nullif((o_custkey % 5) / 4.0, 0)) AS avg_confidence, count(*) FILTER (o_custkey % 3 <> 0) AS with_attributes
    FROM orders WHERE o_orderdate > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2, 3
    """,
)
def fleet_overview(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    versions = orders.select(
        F.col("o_orderpriority").alias("tenant"),
        F.col("o_orderstatus").alias("category"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_custkey") % 5 / 4.0).alias("confidence"),
        F.when(F.col("o_custkey") % 3 == 0, "{}").otherwise('{"k":1}').alias("attributes"),
    )
    return A.fleet_overview(versions, ORDERS_AS_OF, 30)


@query(
    "domain_health",
    f"""
    SELECT 'user' || (user_id % 10) AS domain, event_type AS parser, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS fired,
           count(*) FILTER (event_type <> 'error') AS success
    FROM events WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY GROUP BY 1, 2, 3
    """,
)
def domain_health(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    fired = events.select(F.concat(F.lit("user"), F.col("user_id") % 10).alias("domain"), F.col("event_type").alias("parser"), "ts", (F.col("event_type") != "error").alias("success"))
    return A.domain_health(fired, EVENTS_AS_OF)


@query(
    "field_completeness",
    """
    SELECT lang, count(*) AS n, count(*) FILTER (text <> '') AS with_text, count(*) FILTER (source <> '') AS with_source,
           count(quality) AS with_quality
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
    """,
)
def field_completeness(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.field_completeness(rows, ["text", "source", "quality"], ["lang"])


@query(
    "parser_versions",
    f"""
    SELECT o_orderpriority AS extractor, o_orderstatus AS mapper, 'v' || (o_custkey % 2) AS policy, date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS n
    FROM orders WHERE o_orderdate > TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 60 DAY GROUP BY 1, 2, 3, 4
    """,
)
def parser_versions(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("extractor"), F.col("o_orderstatus").alias("mapper"), F.concat(F.lit("v"), F.col("o_custkey") % 2).alias("policy"), F.col("o_orderdate").alias("created_at")
    )
    return A.parser_versions(runs, ORDERS_AS_OF, 60)


@query(
    "cost_panel",
    f"""
    SELECT event_type AS tenant, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(coalesce(value, 0)), 6) AS cost,
           sum(coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), 0)) AS prompt_tokens, sum(coalesce(TRY_CAST(props->>'$.none' AS DOUBLE), 0)) AS completion_tokens,
           count(*) AS calls
    FROM events WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2
    """,
)
def cost_panel(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tenant"),
        "ts",
        F.col("value").alias("cost"),
        F.get_json_object("props", "$.k").try_cast("double").alias("prompt_tokens"),
        F.get_json_object("props", "$.none").try_cast("double").alias("completion_tokens"),
    )
    return A.cost_panel(calls, EVENTS_AS_OF)


@query(
    "failure_rollup",
    """
    SELECT 'u' || (user_id % 7) AS tenant, event_type AS domain, CASE WHEN value > 10 THEN 'blocked' ELSE 'empty' END AS reason,
           coalesce(props->>'$.none', '') AS raw_key, min(ts) AS first_seen, max(ts) AS last_seen, CAST(sum(1 + event_id % 3) AS BIGINT) AS occurrences, min(event_id) AS id
    FROM events GROUP BY 1, 2, 3, 4
    """,
)
def failure_rollup(spark, sf_dir):
    return A.failure_rollup(failures(spark, sf_dir))


def failures(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id") % 7).alias("tenant"),
        F.col("event_type").alias("domain"),
        F.when(F.col("value") > 10, "blocked").otherwise("empty").alias("reason"),
        F.get_json_object("props", "$.none").alias("raw_key"),
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
        (1 + F.col("event_id") % 3).alias("occurrences"),
        F.col("event_id").alias("id"),
    )


@query(
    "not_in_dedupe",
    """
    SELECT event_id AS id, event_type AS domain FROM events WHERE event_id NOT IN
        (SELECT min(event_id) FROM events GROUP BY user_id % 7, event_type, value > 10)
    """,
)
def not_in_dedupe(spark, sf_dir):
    rows = failures(spark, sf_dir)
    return A.keep_rolled_up(rows, A.failure_rollup(rows)).select("id", "domain")


@query(
    "override_eligible",
    """
    WITH o AS (SELECT l_partkey AS source_key, l_suppkey AS tenant, count(*) AS usage, max(l_shipdate) AS last_used FROM lineitem GROUP BY 1, 2)
    SELECT source_key, tenant, usage FROM o WHERE usage >= 2 AND last_used <= TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 30 DAY
      AND source_key IN (SELECT source_key FROM o GROUP BY 1 HAVING count(DISTINCT tenant) >= 3)
    """,
)
def override_eligible(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("source_key"), F.col("l_suppkey").alias("tenant")).agg(F.count("*").alias("usage"), F.max("l_shipdate").alias("last_used"))
    return A.override_eligible(used.withColumn("flagged", F.lit(False)), "1999-01-01 00:00:00", 2).select("source_key", "tenant", "usage")


@query(
    "schema_promotion",
    """
    WITH p AS (SELECT event_type AS category, unnest(list_concat(json_keys(props), CASE WHEN event_id % 10 < 9 THEN ['v'] ELSE [] END)) AS key, event_id FROM events),
         s AS (SELECT event_type AS category, count(*) AS products FROM events GROUP BY 1 HAVING count(*) >= 20),
         k AS (SELECT category, key, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT category, any_value(products) AS products, string_agg(key, ',' ORDER BY key) AS keys, false AS active
    FROM k JOIN s USING (category) WHERE n >= 0.8 * products AND category <> 'error' GROUP BY category HAVING count(*) >= 2
    """,
)
def schema_promotion(spark, sf_dir):
    with_v = F.when(F.col("event_id") % 10 < 9, F.regexp_replace("props", "^\\{", '{"v": 1, ')).otherwise(F.col("props"))
    products = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), with_v.alias("attributes"))
    known = spark.createDataFrame([("error",)], "category string")
    return A.schema_promotion(products, known, 20, 2).select("category", "products", F.array_join("keys", ",").alias("keys"), "active")


@query(
    "review_clusters",
    """
    SELECT substr(sha256('{"event":"' || event_type || '"}'), 1, 16) AS cluster_key, event_type AS signal, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS severity,
           count(*) AS n, max(ts) AS latest
    FROM events WHERE user_id % 2 = 0 GROUP BY 1, 2, 3
    """,
)
def review_clusters(spark, sf_dir):
    from factloom.functions.scalars import cluster_key

    tasks = table(spark, sf_dir, "events").select(
        cluster_key({"event": F.col("event_type")}).alias("cluster_key"),
        F.col("event_type").alias("signal"),
        F.when(F.col("value") > 10, "high").otherwise("low").alias("severity"),
        F.when(F.col("user_id") % 2 == 0, "open").otherwise("resolved").alias("status"),
        F.col("ts").alias("updated_at"),
    )
    return A.open_clusters(tasks)


@query(
    "null_rate",
    """
    SELECT f AS field, count(*) AS total, count(*) FILTER (v IS NULL OR v = '') AS nulls, count(*) FILTER (v IS NULL OR v = '') / count(*) AS rate
    FROM (SELECT 'quality' AS f, quality::VARCHAR AS v FROM documents LEFT JOIN labels USING (doc_id)
          UNION ALL SELECT 'source', source FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY f
    """,
)
def null_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.null_rates(rows, ["quality", "source"])


@query(
    "null_rate_drift",
    """
    WITH d AS (SELECT lang, quality FROM documents LEFT JOIN labels USING (doc_id)),
         r AS (SELECT (SELECT avg((quality IS NULL)::INT) FROM d WHERE lang = 'en') AS baseline, (SELECT avg((quality IS NULL)::INT) FROM d WHERE lang = 'de') AS current)
    SELECT 'quality' AS field, baseline, current, round(current - baseline, 9) AS delta, abs(round(current - baseline, 9)) >= 0.1 AS drifted FROM r
    """,
)
def null_rate_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return A.null_rate_drift(A.null_rates(rows.filter("lang = 'en'"), ["quality"]), A.null_rates(rows.filter("lang = 'de'"), ["quality"])).select("field", "baseline", "current", "delta", "drifted")


@query(
    "psi_drift",
    """
    WITH c AS (SELECT source, count(*) FILTER (lang = 'en') AS b, count(*) FILTER (lang = 'de') AS c FROM documents WHERE lang IN ('en', 'de') GROUP BY source),
         s AS (SELECT greatest(1e-4, b / (SELECT sum(b) FROM c)) AS p, greatest(1e-4, c / (SELECT sum(c) FROM c)) AS q FROM c),
         t AS (SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s)
    SELECT psi, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS band FROM t
    """,
)
def psi_drift(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source")
    return A.psi(docs.filter("lang = 'en'"), docs.filter("lang = 'de'"), "source").withColumn("psi", F.round("psi", 6))


@query(
    "schema_drift",
    """
    WITH k AS (SELECT event_type = 'view' AS cur, CASE WHEN event_type = 'view' OR user_id % 50 = 0 THEN ['a', 'new' || (user_id % 3)] ELSE ['a', 'old'] END AS keys
               FROM events WHERE event_type IN ('view', 'click')),
         f AS (SELECT key, count(*) FILTER (NOT cur) / (SELECT count(*) FROM k WHERE NOT cur) AS baseline, count(*) FILTER (cur) / (SELECT count(*) FROM k WHERE cur) AS current
               FROM (SELECT cur, unnest(keys) AS key FROM k) GROUP BY key)
    SELECT key, baseline, current, CASE WHEN current >= 0.2 AND baseline < 0.02 THEN 'new' ELSE 'vanished' END AS change FROM f
    WHERE (current >= 0.2 AND baseline < 0.02) OR (baseline >= 0.2 AND current < 0.02)
    """,
)
def schema_drift(spark, sf_dir):
    fresh = F.array(F.lit("a"), F.concat(F.lit("new"), F.col("user_id") % 3))
    keys = F.when((F.col("event_type") == "view") | (F.col("user_id") % 50 == 0), fresh).otherwise(F.array(F.lit("a"), F.lit("old")))
    events = table(spark, sf_dir, "events").select("event_type", keys.alias("keys"))
    return A.schema_drift(events.filter("event_type = 'click'"), events.filter("event_type = 'view'"))


@query(
    "cohort_cap",
    """
    SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 500
    """,
)
def cohort_cap(spark, sf_dir):
    return A.newest(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.col("event_id")])


@query(
    "drift_scan",
    f"""
    WITH s AS (SELECT event_type AS category, event_id, ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY AS cur, CASE WHEN value > 10 THEN value END AS v, ts FROM events),
         c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY category, cur ORDER BY ts DESC, event_id) <= 500),
         r AS (SELECT category, 'v' AS field, avg((v IS NULL)::INT) FILTER (NOT cur) AS baseline, avg((v IS NULL)::INT) FILTER (cur) AS current FROM c GROUP BY category)
    SELECT category, field, baseline, current, round(current - baseline, 9) AS delta, abs(round(current - baseline, 9)) >= 0.1 AS drifted FROM r
    WHERE baseline IS NOT NULL AND current IS NOT NULL
    """,
)
def drift_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("id"), F.when(F.col("value") > 10, F.col("value")).alias("v"), F.col("ts").alias("created_at"))
    return A.drift_scan(rows, ["v"], EVENTS_AS_OF)


@query(
    "slo_burn",
    f"SELECT count(*) AS n, round(avg((event_type = 'error')::INT) / 0.1, 9) AS burn FROM events WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 28 DAY",
)
def slo_burn(spark, sf_dir):
    return A.slo_burn(table(spark, sf_dir, "events"), F.col("event_type") != "error", EVENTS_AS_OF)


@query(
    "shadow_compare",
    """
    SELECT field, count(*) AS compared, CAST(sum(different) AS BIGINT) AS different FROM (
      SELECT 'text' AS field, (trim(text, ' ') IS DISTINCT FROM text)::INT AS different FROM documents
      UNION ALL SELECT 'lang', 0 FROM documents) GROUP BY field
    """,
)
def shadow_compare(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return A.shadow_compare(docs, docs.withColumn("text", F.trim("text")), "doc_id", ["text", "lang"])


@query(
    "latest_version",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def latest_version(spark, sf_dir):
    return A.latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query(
    "canary",
    """
    WITH p AS (SELECT 'r' || (user_id % 20) AS retailer, event_id, event_type FROM events
               QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) <= 5)
    SELECT retailer, count(*) AS sampled, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type <> 'error') / count(*) AS pass_rate FROM p GROUP BY retailer
    """,
)
def canary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    retailer = F.concat(F.lit("r"), F.col("user_id") % 20).alias("retailer")
    pages = events.select(retailer, F.col("event_id").alias("ordinal"), F.when(F.col("event_type") == "error", F.array(F.lit("title"))).otherwise(F.array(F.lit("title"), F.lit("price"))).alias("fields"))
    wanted = events.select(retailer).distinct().withColumn("wanted", F.array(F.lit("price"), F.lit("title")))
    return A.canary(pages, wanted)


def samples(spark, sf_dir):
    """Reviewer outcomes: a document's quality label against a raw confidence from its length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.least(F.col("n_chars"), F.lit(4000)).cast("int") / 1000).cast("int").alias("step"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("outcome")), "doc_id").select("lang", ((1 + F.col("step")) / 5).alias("raw"), "outcome")


@query(
    "isotonic_refit",
    """
    WITH s AS (SELECT lang, (1 + floor(least(n_chars, 4000) / 1000)) / 5 AS x, avg(quality) AS y, count(*) AS w FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
         m AS (SELECT a.lang, a.x AS j, b.x AS k, sum(c.y * c.w) / sum(c.w) AS v FROM s a JOIN s b ON a.lang = b.lang AND a.x <= b.x JOIN s c ON c.lang = a.lang AND c.x BETWEEN a.x AND b.x GROUP BY 1, 2, 3),
         f AS (SELECT s.lang, s.x, max(lo) AS v FROM s JOIN (SELECT m.lang, s.x, m.j, min(m.v) AS lo FROM m JOIN s ON m.lang = s.lang AND m.j <= s.x AND m.k >= s.x GROUP BY 1, 2, 3) q USING (lang, x) GROUP BY 1, 2)
    SELECT lang, x AS raw, round(v, 6) AS calibrated FROM f WHERE lang IN (SELECT lang FROM s GROUP BY 1 HAVING sum(w) >= 30)
    """,
)
def isotonic_refit(spark, sf_dir):
    """Calibrated value of each raw confidence, by language."""
    s = samples(spark, sf_dir)
    models = C.refit(s, ["lang"])
    facts = s.select("lang", F.col("raw").alias("confidence")).distinct().join(models.select("lang"), "lang", "left_semi")
    return C.calibrate(facts, models, ["lang"]).select("lang", F.col("confidence").alias("raw"), F.round("calibrated", 6).alias("calibrated"))


@query(
    "beta_prior",
    """
    SELECT source, 1 + count(*) FILTER (quality = 1) AS alpha, 1 + count(*) FILTER (quality = 0) AS beta,
           round((1 + count(*) FILTER (quality = 1)) / (2 + count(*)), 9) AS mean
    FROM documents JOIN labels USING (doc_id) GROUP BY source
    """,
)
def beta_prior(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("outcome")), "doc_id")
    return C.beta_prior(s, ["source"])


@query(
    "provenance_join",
    """
    SELECT r_name AS region, n_name AS nation, count(*) AS facts, round(sum(l_extendedprice), 2) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2
    """,
)
def provenance_join(spark, sf_dir):
    """Facts along their foreign keys up to the region; line items are summed per order before they meet customers."""
    t = lambda n: table(spark, sf_dir, n)
    per_order = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("v"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    joined = per_order.join(t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(t("customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return joined.join(places, "c_nationkey").groupBy("region", "nation").agg(F.sum("n").alias("facts"), F.round(F.sum("v"), 2).alias("value"))


@query("orphans", "SELECT o_orderkey, o_orderstatus FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def orphans(spark, sf_dir):
    """Runs without a fact of note."""
    heavy = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(heavy, "o_orderkey", "left_anti")


@query("recent_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def recent_orders(spark, sf_dir):
    """Top-k report: the newest hundred."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@query("artifact_dedup", "SELECT sha256(text) AS checksum, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def artifact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return docs.groupBy("checksum").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
