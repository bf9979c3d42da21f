"""Review, catalog and evidence: rows derived from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import analytics as A
from factloom.operators import facts as X
from factloom.operators import policy as P
from factloom.operators import resolve as R
from factloom.operators import review as V
from factloom.plans.fixtures import dealt, values
from factloom.plans.register import query
from factloom.sources.tables import table

STRING_MAP = "map<string,string>"


def text_map(**values_) -> object:
    """A map of texts; entries with a null value are left out."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values_.items()]), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


# Evidence.


@query(
    "run_facts",
    """
    SELECT fact_set, raw_key, greatest(0.0, least(1.0, min(confidence))) AS confidence, count(*) > 0 AS is_new
    FROM (SELECT l_orderkey AS fact_set, 'k' || l_linenumber AS raw_key, l_quantity / 25 - 0.5 AS confidence FROM lineitem) WHERE fact_set % 3 <> 0 OR raw_key = 'k1' GROUP BY 1, 2
    """,
)
def run_facts(spark, sf_dir):
    """Facts of sets that are new; those of each third order are stored but for the first line's."""
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_set"), F.concat(F.lit("k"), F.col("l_linenumber").cast("string")).alias("raw_key"), (F.col("l_quantity") / 25 - 0.5).alias("confidence"))
    stored = facts.filter("fact_set % 3 = 0 AND raw_key <> 'k1'")
    return V.new_facts(facts, stored, ["fact_set", "raw_key"]).withColumn("is_new", F.lit(True))


def versions_to_fill(spark, sf_dir):
    p = F.col("p_partkey")
    own = F.when(p % 3 == 0, text_map(size=F.col("p_size"))).when(p % 3 == 1, F.create_map().cast(STRING_MAP))
    extra = F.when(p % 4 != 0, F.struct(F.when(p % 5 != 0, text_map(brand=F.col("p_brand"))).otherwise(F.create_map().cast(STRING_MAP)).alias("attributes"), text_map(by=F.lit("extension")).alias("evidence")))
    return table(spark, sf_dir, "part").select(p.alias("version"), own.alias("attributes"), F.create_map().cast(STRING_MAP).alias("evidence"), extra.alias("extensions"))


@query("backfill_attributes", "SELECT p_partkey AS version, CASE WHEN p_partkey % 3 = 0 THEN 'size=' || p_size WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN 'brand=' || p_brand ELSE '' END AS attributes, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN 'extension' END AS evidence FROM part")
def backfill_attributes(spark, sf_dir):
    filled, _ = V.backfill(versions_to_fill(spark, sf_dir))
    pairs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return filled.select("version", F.coalesce(pairs, F.lit("")).alias("attributes"), F.try_element_at("evidence", F.lit("by")).alias("evidence"))


@query("backfill_counts", "SELECT count(*) FILTER (p_partkey % 3 <> 0) AS examined, count(*) FILTER (p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 <> 0) AS would_update FROM part")
def backfill_counts(spark, sf_dir):
    return V.backfill(versions_to_fill(spark, sf_dir))[1]


@query(
    "ladder_events",
    """
    SELECT ts, 't' || (user_id % 3) AS tenant, 'worker' AS actor_type, 'ladder.rung_fired' AS event_type, 'field' AS entity_type, 'k' || (event_id % 5) AS entity_id,
           '{"rung":"' || event_type || '","domain":"d' || (user_id % 7) || '","parserVersion":"v1"}' AS metadata FROM events
    """,
)
def ladder_events(spark, sf_dir):
    joined = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    rows = table(spark, sf_dir, "events").select("ts", joined("t", F.col("user_id") % 3).alias("tenant"), joined("k", F.col("event_id") % 5).alias("raw_key"), F.col("event_type").alias("rung"), joined("d", F.col("user_id") % 7).alias("domain"), F.lit("v1").alias("parser_version"))
    return V.ladder_events(rows)


@query("selector_events", "SELECT 's' || (event_id % 4) AS entity_id, count(*) AS fired, count(*) FILTER (value > 50) AS success FROM events GROUP BY 1")
def selector_events(spark, sf_dir):
    """Firings as events, and what their metadata say."""
    rows = table(spark, sf_dir, "events").select("ts", F.lit("t").alias("tenant"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("selector"), F.lit("d").alias("domain"), (F.col("value") > 50).alias("success"), F.lit("v1").alias("parser_version"))
    said = F.get_json_object("metadata", "$.success") == "true"
    return V.selector_events(rows).groupBy("entity_id").agg(F.count("*").alias("fired"), F.count_if(said).alias("success"))


_POINTERS = [
    ("dom_heuristic:price", "dom_heuristic"), ("vision:size", "vision_llm"), ("json_ld.name", "json_ld"), ("nuxt:product", "nuxt"), ("window.__NUXT__.x", "nuxt"), ("og:title", "opengraph"), ("opengraph.x", "opengraph"), ("rdfa:name", "rdfa"), ("schema:name", "rdfa"),
    ("per:amazon:title", "per_site_parser:amazon"), ("x.specs-table[a]", "per_site_parser:bestbuy"), (".priceView-x", "per_site_parser:bestbuy"), ("h1.pd-title", "per_site_parser:croma"), ("walmart-spec[a]", "per_site_parser:walmart"), ("ebay", "per_site_parser:ebay"), ("$.title", "direct"), (None, "direct"),
]


@query("provenance_rung", f"SELECT event_id, rung FROM events JOIN {values([(i, r) for i, (_, r) in enumerate(_POINTERS)], 'm, rung')} ON event_id % {len(_POINTERS)} = m")
def provenance_rung(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.rung(dealt([p for p, _ in _POINTERS], F.col("event_id")), F.lit("direct")).alias("rung"))


# Tasks and reading.

_KINDS = ["fetch_failed", "captcha_wall", "no_data_extracted", "artifact_duplicate"]
_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"


@query("failure_tasks", f"SELECT page_id AS artifact, (ARRAY{_KINDS})[page_id % 4 + 1] AS kind, CASE page_id % 4 WHEN 3 THEN 'low' ELSE 'high' END AS severity, {_DOMAIN} AS domain, substr(sha256('{{\"domain\":\"' || {_DOMAIN} || '\",\"signal_kind\":\"' || (ARRAY{_KINDS})[page_id % 4 + 1] || '\"}}'), 1, 16) AS cluster_key FROM pages")
def failure_tasks(spark, sf_dir):
    return V.failure_tasks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact"), dealt(_KINDS, F.col("page_id")).alias("kind"), "url"))


@query("task_status", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'resolved' WHEN 2 THEN 'dismissed' ELSE 'open' END AS status FROM orders")
def task_status(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 5 < 4, dealt(["in_progress", "resolved", "dismissed", "odd", "odd"], F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.normal_status(status).alias("status"))


@query("tenant_page", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey > 20 ORDER BY p_partkey LIMIT 25")
def tenant_page(spark, sf_dir):
    """A page of a tenant's products after a key, without the deleted."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p, "p_name", F.concat(F.lit("t"), (p % 3).cast("string")).alias("tenant"), F.concat(F.lit("m"), (p % 2).cast("string")).alias("merchant"), F.when(p % 5 == 0, "deleted").when(p % 7 != 0, "active").alias("status"))
    return V.page_after(V.not_deleted(V.of_tenant(rows, "t1", "m0")), "p_partkey", 20, 25).select("p_partkey", "p_name")


@query(
    "tasks_nested",
    """
    WITH f AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS least FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS task, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderstatus END AS diff_status, CASE WHEN o_orderkey % 4 <> 0 THEN coalesce(n, 0) ELSE 0 END AS n_fields,
           CASE WHEN o_orderkey % 4 <> 0 THEN least END AS first_line, c_mktsegment AS segment
    FROM orders LEFT JOIN f ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    """,
)
def tasks_nested(spark, sf_dir):
    orders, o = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tasks = orders.select(o.alias("task"), F.when(o % 4 != 0, o).alias("diff_id"), F.col("o_custkey").alias("artifact"))
    diffs = orders.filter(o % 3 != 0).select(o.alias("diff_id"), F.col("o_orderstatus").alias("status"))
    fields = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("diff_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    artifacts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact"), F.col("c_mktsegment").alias("segment"))
    n = V.tasks_with_diffs(tasks, diffs, fields, artifacts)
    return n.select("task", F.col("diff.status").alias("diff_status"), F.size("fields").cast("long").alias("n_fields"), F.get("fields", F.lit(0))["line"].alias("first_line"), F.col("artifact_row.segment").alias("segment"))


@query(
    "artifacts_recent",
    """
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
         n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT c_custkey AS artifact, o_orderkey AS run, o_orderpriority AS extractor, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS fact_count
    FROM customer LEFT JOIN r ON c_custkey = o_custkey LEFT JOIN n ON o_orderkey = l_orderkey
    """,
)
def artifacts_recent(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    runs = orders.select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("artifact"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("extractor"))
    sets = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") * 10).alias("fact_set"))
    facts = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10).alias("fact_set"))
    return V.recent_artifacts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact")), runs, sets, facts)


@query(
    "products_variants",
    """
    WITH v AS (SELECT l_partkey, count(*) AS n, min(l_suppkey) AS least FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1)
    SELECT p_partkey AS product, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title, coalesce(n, 0) AS n_variants, least::VARCHAR AS first_variant FROM part LEFT JOIN v ON p_partkey = l_partkey WHERE p_partkey % 5 <> 0
    """,
)
def products_variants(spark, sf_dir):
    parts, p = table(spark, sf_dir, "part"), F.col("p_partkey")
    products = parts.select(p.alias("product"), F.when(p % 3 != 0, p).alias("current_version"), F.when(p % 5 == 0, "deleted").otherwise("active").alias("status"), F.col("p_size").alias("updated_at"))
    versions = parts.select(p.alias("version"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0").alias("variant_key"), F.col("l_suppkey").cast("string").alias("sku"), F.lit(1.0).alias("price")).distinct()
    n = V.products_with_variants(products, versions, lines)
    return n.select("product", "title", F.size("variants").cast("long").alias("n_variants"), F.get("variants", F.lit(0))["sku"].alias("first_variant"))


@query("source_types", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS source_types FROM lineitem GROUP BY 1")
def source_types(spark, sf_dir):
    found = V.source_types(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("source_type")), "l_suppkey")
    return found.select("l_suppkey", F.array_join("source_types", "|").alias("source_types"))


# Analytics over joins.


@query(
    "calibration_join",
    """
    SELECT o_orderpriority AS extractor, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS category, c_mktsegment AS source_type, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS approved, round(sum(l_discount), 6) AS raw
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2, 3
    """,
)
def calibration_join(spark, sf_dir):
    orders, o = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_set"), F.col("l_discount").alias("confidence"))
    sets = orders.select(o.alias("fact_set"), (o + 1).alias("run"))
    runs = orders.select((o + 1).alias("run"), F.col("o_orderpriority").alias("extractor"), F.col("o_custkey").alias("artifact"))
    artifacts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact"), F.col("c_mktsegment").alias("source_type"))
    diffs = orders.select(o.alias("fact_set"), (o * 2).alias("diff_id"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("open").alias("status"))
    versions = orders.filter(o % 2 == 0).select((o * 2).alias("diff_id"), F.lit("even").alias("category"))
    rows = V.calibration_rows(facts, sets, runs, artifacts, diffs, versions)
    return rows.groupBy("extractor", "category", "source_type").agg(F.count("*").alias("n"), F.sum("outcome").cast("long").alias("approved"), F.round(F.sum("raw_confidence"), 6).alias("raw"))


@query(
    "profile_join",
    """
    WITH r AS (SELECT regexp_replace(split_part(split_part(regexp_replace(lower(url), '^[a-z]+://', ''), '/', 1), ':', 1), '^www\\.', '') AS domain, event_id,
                      CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN value / 100 END AS confidence, event_type FROM events JOIN pages ON event_id % 50 + 1 = page_id)
    SELECT domain, count(*) AS n, round(avg((event_type ILIKE '%cli%')::INT), 9) AS llm_share, round(avg(confidence), 9) AS avg_confidence FROM r GROUP BY domain
    """.replace("ILIKE '%cli%'", "= 'click'"),
)
def profile_join(spark, sf_dir):
    events, e = table(spark, sf_dir, "events"), F.col("event_id")
    runs = events.select(e.alias("run"), (e % 50 + 1).alias("artifact"), F.when(F.col("event_type") == "click", "llm-v1").otherwise("rules-v1").alias("extractor"))
    artifacts = table(spark, sf_dir, "pages").select(F.col("page_id").alias("artifact"), "url")
    sets = events.filter(e % 2 == 0).select(e.alias("run"), (e * 10).alias("fact_set"))
    diffs = events.filter(e % 3 != 0).select((e * 10).alias("fact_set"), (F.col("value") / 100).alias("confidence"))
    from factloom.functions.scalars import loose_host

    rows = V.profile_rows(runs, artifacts, sets, diffs)
    return A.domain_profile(rows.select(loose_host(F.col("url")).alias("domain"), "extractor", "confidence"))


@query(
    "failures_rolled_up",
    """
    WITH f AS (SELECT event_id AS id, event_type AS domain, user_id % 3 AS reason, ts FROM events), g AS (SELECT domain, reason, min(id) AS id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT f.domain, f.reason, f.id, coalesce(a, ts) AS first_seen, coalesce(b, ts) AS last_seen, coalesce(n, 1) AS occurrences FROM f LEFT JOIN g USING (id)
    """,
)
def failures_rolled_up(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("domain"), (F.col("user_id") % 3).alias("reason"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1).cast("long").alias("occurrences"))
    grouped = rows.groupBy("domain", "reason").agg(F.min("id").alias("id"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"))
    return V.rolled_up(rows, grouped, ["domain", "reason"])


@query(
    "shadow_fields",
    """
    SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'title' END, CASE WHEN p_partkey % 4 = 0 THEN 'attributes.a' END, CASE WHEN p_partkey % 5 = 0 THEN 'attributes.b' END], lambda x: x IS NOT NULL), '|') AS differing,
           ((p_partkey % 3 = 0)::INT + (p_partkey % 4 = 0)::INT + (p_partkey % 5 = 0)::INT) / 3.0 AS diff_ratio FROM part
    """,
)
def shadow_fields(spark, sf_dir):
    p = F.col("p_partkey")
    old = F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), text_map(a=F.lit("1"), b=F.lit("2")).alias("attributes"))
    new = F.struct(F.when(p % 3 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("brand"), text_map(a=F.when(p % 4 == 0, "9").otherwise("1"), b=F.when(p % 5 != 0, "2")).alias("attributes"))
    both = A.shadow_fields(table(spark, sf_dir, "part").select("p_partkey", old.alias("o"), new.alias("n")), "o", "n", ["title", "brand"], ["attributes"])
    return both.select("p_partkey", F.array_join("differing", "|").alias("differing"), "diff_ratio")


@query("shadow_rate", "SELECT 'f' || (user_id % 4) AS field, count(*) AS n FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY 1")
def shadow_rate(spark, sf_dir):
    name = F.concat(F.lit("f"), (F.col("user_id") % 4).cast("string"))
    rows = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "error", "shadow.diff_detected").otherwise("other").alias("event_type"), F.to_json(F.struct(name.alias("field"))).alias("metadata"))
    return A.shadow_rate(rows, F.lit("2024-01-30").cast("timestamp_ntz"))


# Payloads and variants.

#: Payloads; title, type of gtin, price, currency, length, images, variants, first option, attributes.
_PAYLOADS = [
    ('{"title":" Tee ","gtin_type":"ean","base_price":"12.5","currency":"eur","dimensions_cm":{"l":"10"},"images":[{"url":"http://a"},{"alt_text":"x"}],"variants":[{"sku":"a","option_values":{"size":"M","x":""}}],"attributes":{"a":"1"}}', "Tee", "ean", 12.5, "EUR", 10.0, 1, 1, "M", 1),
    ('{"title":"","gtinType":"upc","basePrice":9,"dimensionsCm":{"q":1},"weight_grams":"heavy"}', None, "upc", 9.0, None, None, 0, None, None, 0),
    ("{}", None, None, None, None, None, 0, None, None, 0),
]


@query("payload_parse", f"SELECT p_partkey, title, gtin_type, price::DOUBLE AS price, currency, length_cm::DOUBLE AS length_cm, n_images, n_variants, size, n_attributes FROM part JOIN {values([(i, *p[1:]) for i, p in enumerate(_PAYLOADS)], 'm, title, gtin_type, price, currency, length_cm, n_images, n_variants, size, n_attributes')} ON p_partkey % {len(_PAYLOADS)} = m")
def payload_parse(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_partkey", V.payload(dealt([p[0] for p in _PAYLOADS], F.col("p_partkey"))).alias("x"))
    size = F.try_element_at(F.get("x.variants", F.lit(0))["optionValues"], F.lit("size"))
    n = lambda c: F.size(c)
    return x.select("p_partkey", "x.title", F.col("x.gtinType").alias("gtin_type"), F.col("x.basePrice").alias("price"), "x.currency", F.col("x.dimensionsCm.l").alias("length_cm"), n("x.images").alias("n_images"), F.when(F.col("x.variants").isNotNull(), n("x.variants")).alias("n_variants"), size.alias("size"), n("x.attributes").alias("n_attributes"))


@query(
    "rehydrate",
    """
    SELECT p_partkey AS diff_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'fact ' || p_partkey END AS title, CASE p_partkey % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'B' END AS brand, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size + 0.5 END AS price, 'USD' AS currency FROM part
    """,
)
def rehydrate(spark, sf_dir):
    """Payloads without some core fields, and facts that fill them: blank ones don't, a raw key goes before its stand-in."""
    p, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    diffs = parts.select(p.alias("diff_id"), p.alias("fact_set"), V.payload(F.to_json(F.struct(F.when(p % 3 == 0, F.col("p_name")).alias("title")))).alias("payload"))
    one = lambda key, value, i: F.struct(F.lit(key).alias("raw_key"), value.cast("string").alias("value"), F.lit(i).alias("ordinal"))
    facts = F.array(
        one("title", F.concat(F.lit("fact "), p.cast("string")), 0), one("vendor", F.when(p % 4 < 2, "V"), 1), one("brand", F.when(p % 4 == 1, "B").otherwise(" "), 2), one("price", F.when(p % 5 != 0, F.lit(1.0)), 3),
        one("base_price", F.when(p % 5 != 0, F.col("p_size") + 0.5), 4), one("currency", F.lit("usd"), 5),
    )
    rows = parts.select(p.alias("fact_set"), F.explode(facts).alias("f")).select("fact_set", "f.*")
    done = V.refilled(diffs, rows)
    return done.select("diff_id", "payload.title", "payload.brand", F.col("payload.basePrice").alias("price"), "payload.currency")


@query(
    "variants_extract",
    """
    SELECT o_orderkey AS page, v AS variant, 'sku' || v AS sku, CASE WHEN v = 0 THEN 9.5 END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'Size' ELSE 'Fit|Size' END AS axes,
           substr(sha256(CASE WHEN o_orderkey % 3 = 0 THEN '{"size":"m' || v || '"}' ELSE '{"fit":"slim","size":"m' || v || '"}' END), 1, 16) AS variant_key
    FROM orders, (VALUES (0), (1)) t(v)
    """,
)
def variants_extract(spark, sf_dir):
    """Variants of orders; a third has a category whose schema names one axis of two."""
    one = lambda key, value: F.struct(F.lit(key).alias("raw_key"), F.lit(value).alias("value"))
    each = [one(f"variants[{v}].{k}", x) for v in (0, 1) for k, x in (("sku", f"sku{v}"), ("option.Size", f" M{v} "), ("option.Fit", "Slim"))] + [one("variants[0].price", "9.5"), one("title", "t")]
    category = F.when(F.col("o_orderkey") % 3 == 0, "sized").when(F.col("o_orderkey") % 3 == 1, "free")
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), category.alias("category"), F.posexplode(F.array(*each)).alias("ordinal", "f")).select("page", "category", "ordinal", "f.*", F.lit(0.9).alias("confidence"))
    schemas = spark.createDataFrame([("sized", ["Size"])], "category string, axes array<string>")
    return X.extract_variants(facts, schemas).select("page", "variant", "sku", "price", F.array_join(F.array_sort(F.map_keys("axes")), "|").alias("axes"), "variant_key")


@query("parent_fields", "SELECT l_orderkey AS page, max_by(l_quantity, (l_linenumber * 1e9 + l_partkey * 1e4 + l_suppkey) * 100 + l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1")
def parent_fields(spark, sf_dir):
    order = (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity")
    key = F.when(F.col("l_suppkey") % 2 == 0, "quantity")
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit("qty").alias("raw_key"), key.alias("canonical_key"), F.col("l_quantity").cast("string").alias("value"), order.alias("ordinal"))
    return X.parent_fields(facts).select("page", F.try_element_at("fields", F.lit("quantity")).cast("double").cast("long").alias("quantity"))


@query("overlay_rules", "SELECT p_partkey AS id, p_type NOT LIKE 'PROMO%' OR (p_size >= 5 AND p_size <= 20) AS valid FROM part")
def overlay_rules(spark, sf_dir):
    """A strict category's rule and what a tenant adds to it; other tenants' rules, and those of lax categories, don't count."""
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type").startswith("PROMO"), "strict").otherwise("lax").alias("category"), text_map(size=F.col("p_size")).alias("attributes"))
    rules = spark.createDataFrame([("strict", "authoritative", "size", "maximum", "20"), ("lax", "inferred", "size", "maximum", "1")], "category string, tier string, key string, keyword string, arg string")
    overlay = spark.createDataFrame([("t1", "strict", "authoritative", "size", "minimum", "5"), ("t1", "lax", "authoritative", "size", "maximum", "0"), ("t2", "strict", "authoritative", "size", "maximum", "0")], "tenant string, category string, tier string, key string, keyword string, arg string")
    return P.validate(records, P.with_overlay(rules, overlay, "t1")).select("id", "valid")


@query(
    "identities",
    """
    WITH p AS (SELECT p_partkey AS product, ltrim((p_partkey % 50)::VARCHAR, '0') AS g, 'b' || (p_partkey % 4) AS b, CASE WHEN p_partkey % 6 <> 0 THEN 'M' || p_size END AS m FROM part)
    SELECT product, 'gtin' AS type, g AS value FROM p WHERE g <> '' UNION ALL SELECT product, 'mpn', m FROM p WHERE m IS NOT NULL UNION ALL SELECT product, 'brand_mpn', b || ':' || lower(m) FROM p WHERE m IS NOT NULL
    UNION ALL SELECT product, 'sku', 's' || product FROM p UNION ALL SELECT product, 'gtin', '77' FROM p
    """,
)
def identities(spark, sf_dir):
    p = F.col("p_partkey")
    variants = F.array(F.struct(F.concat(F.lit(" s"), p.cast("string")).alias("sku"), F.lit("0-77").alias("barcode")), F.struct(F.lit(" ").alias("sku"), F.lit(None).cast("string").alias("barcode")))
    rows = table(spark, sf_dir, "part").select(p.alias("product"), F.concat(F.lit("00-"), (p % 50).cast("string")).alias("gtin"), F.concat(F.lit(" B"), (p % 4).cast("string")).alias("brand"), F.when(p % 6 != 0, F.concat(F.lit("M"), F.col("p_size").cast("string"))).alias("mpn"), variants.alias("variants"))
    return R.identities(rows).drop("position")


# Applying and deciding.


def rows_of(tables: dict) -> object:
    """The named tables as one: name, and three texts a row."""
    out = None
    for name, (df, columns) in tables.items():
        texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns] + [F.lit("")] * (3 - len(columns))
        part = df.select(F.lit(name).alias("what"), *[t.alias(f"c{i}") for i, t in enumerate(texts)])
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "apply_diffs",
    """
    WITH d AS (SELECT p_partkey AS id, p_partkey % 8 AS m FROM part), on_ AS (SELECT * FROM d WHERE m NOT IN (0, 1)), ok AS (SELECT *, CASE m WHEN 4 THEN 'known' WHEN 5 THEN 'p5' WHEN 6 THEN 'p6' ELSE 'new:' || id END AS product FROM on_ WHERE m NOT IN (2, 3))
    SELECT 'errors' AS what, id::VARCHAR AS c0, CASE m WHEN 2 THEN 'no title' ELSE 'missing: material' END AS c1, '' AS c2 FROM on_ WHERE m IN (2, 3)
    UNION ALL SELECT 'versions', id::VARCHAR, product, CASE m WHEN 7 THEN 'refilled' ELSE 'Tent ' || m END FROM ok
    UNION ALL SELECT 'products', product, id::VARCHAR, (m = 7)::VARCHAR FROM ok
    UNION ALL SELECT 'tasks', id::VARCHAR, 'schema_violation', '' FROM on_ WHERE m = 3
    UNION ALL SELECT 'tasks', id::VARCHAR, 'value_conflict', 'value_conflict:p6' FROM on_ WHERE m = 6
    UNION ALL SELECT DISTINCT 'identities', 'p5', 'gtin', '555' FROM ok WHERE m = 5
    UNION ALL SELECT DISTINCT 'identities', 'p6', 'gtin', '666' FROM ok WHERE m = 6
    """,
)
def apply_diffs(spark, sf_dir):
    """Parts as diffs: open ones, ones with a version, without a title, against a schema, of a known identity, of a given
    product that is like or not so like it, and ones that facts refill."""
    p = F.col("p_partkey")
    m, parts = p % 8, table(spark, sf_dir, "part")
    value = lambda *pairs: F.coalesce(*[F.when(m == i, v) for i, v in pairs], F.lit(None).cast("string"))
    payload = F.struct(
        F.when(~m.isin(2, 7), F.concat(F.lit("Tent "), m.cast("string"))).alias("title"), value((4, "0044"), (5, "555"), (6, "666")).alias("gtin"), value((6, "Brandless")).alias("brand"),
        F.when(m.isin(3, 4), "camping/tents").alias("canonicalCategory"), F.when(m == 4, text_map(material=F.lit("nylon"))).alias("attributes"),
    )
    diffs = parts.select(p.alias("diff_id"), p.alias("fact_set"), value((5, "p5"), (6, "p6")).alias("product"), F.when(m == 0, "open").otherwise("approved").alias("status"), F.to_json(payload).alias("payload"))
    had = parts.filter(m == 1).select(p.alias("diff_id"), F.lit("old").alias("product"), *[F.lit(None).cast("string").alias(c) for c in ("gtin", "modelNumber", "title", "brand")], F.lit(0).cast("long").alias("created_at"))
    old = spark.createDataFrame([(-1, "p5", "555", None, "Tent 5", None, 1), (-2, "p6", "666", "m", "Tent 6", "brandless", 5), (-3, "p6", "666", None, "Tent 6", "Brandless", 1)], had.schema)
    old = old.withColumn("gtin", F.when(F.col("diff_id") == -2, "999").otherwise(F.col("gtin")))
    facts = parts.filter(m == 7).select(p.alias("fact_set"), F.lit("title").alias("raw_key"), F.lit("refilled").alias("value"), F.lit(0).alias("ordinal"))
    rules = spark.createDataFrame([("camping/tents", "authoritative", "material", "required", "")], "category string, tier string, key string, keyword string, arg string")
    known = spark.createDataFrame([("known", "gtin", "44")], "product string, type string, value string")
    t = V.apply_diffs(diffs, had.unionByName(old), facts, rules, known)
    return rows_of({"errors": (t["errors"], ["diff_id", "error"]), "versions": (t["versions"], ["diff_id", "product", "title"]), "products": (t["products"], ["product", "diff_id", "is_new"]), "tasks": (t["tasks"], ["diff_id", "kind", "cluster_key"]), "identities": (t["identities"], ["product", "type", "value"])})


@query(
    "decide",
    """
    WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS m, 'd' || (o_orderkey % 3) || '.example' AS dom FROM orders)
    SELECT 'overrides' AS what, dom AS c0, 'colour' AS c1, 'color' AS c2 FROM o WHERE m = 0
    UNION ALL SELECT DISTINCT 'synonyms', 'colour', 'color', 'human_review' FROM o WHERE m = 0
    UNION ALL SELECT 'failures', dom, 'wrong_value', count(*)::VARCHAR FROM o WHERE m = 2 GROUP BY dom
    UNION ALL SELECT 'identities', 'p', 'url', 'https://www.' || dom || '/' || id FROM o WHERE m = 3
    UNION ALL SELECT 'diffs', id::VARCHAR, CASE WHEN m = 3 THEN 'rejected' WHEN m = 4 THEN 'approved' ELSE 'open' END, CASE m WHEN 1 THEN 'edited' ELSE 'as it was' END FROM o
    UNION ALL SELECT 'tasks', (id * 10 + k)::VARCHAR, CASE WHEN (k = 0 AND m <> 5) THEN 'resolved' WHEN k = 1 AND m <> 1 THEN 'dismissed' ELSE 'open' END, '' FROM o, (VALUES (0), (1)) t(k)
    UNION ALL SELECT 'to_apply', id::VARCHAR, '', '' FROM o WHERE m IN (0, 2)
    """,
)
def decide(spark, sf_dir):
    """Orders as diffs of two tasks: an override, an edit with another task open, a rejection, a merge, an edit of what is decided, none."""
    o = F.col("o_orderkey")
    m, orders = o % 6, table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://www.d"), (o % 3).cast("string"), F.lit(".example/"), o.cast("string"))
    diffs = orders.select(o.alias("diff_id"), o.alias("fact_set"), F.when(m == 4, "approved").otherwise("open").alias("status"), text_map(title=F.lit("as it was")).alias("payload"))
    artifacts = orders.select(o.alias("fact_set"), url.alias("url"))
    tasks = orders.select(o, m.alias("m"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    tasks = tasks.select((o * 10 + F.col("k")).alias("task"), F.lit("t").alias("tenant"), o.alias("diff_id"), F.when((F.col("k") == 0) | (F.col("m") == 1), "open").otherwise("dismissed").alias("status"), F.lit("title").alias("field"))
    text = lambda *pairs: F.coalesce(*[F.when(m == i, v) for i, v in pairs], F.lit(None).cast("string"))
    decisions = orders.filter(m != 5).select(
        (o * 10).alias("task"), text((0, "edit"), (1, "edit"), (2, "reject"), (3, "merge"), (4, "edit")).alias("action"), text((0, "colour"), (1, "title"), (4, "title")).alias("field"), text((0, " "), (1, "edited")).alias("value"),
        text((0, "color")).alias("canonical_key"), text((2, "wrong_value")).alias("reason"), F.lit("note").alias("note"), text((3, "p")).alias("product"), F.lit(1).alias("at"),
    )
    earlier = decisions.withColumns({"action": F.lit("reject"), "reason": F.lit("wrong_category"), "at": F.lit(0)})
    t = V.decide(decisions.unionByName(earlier), tasks, diffs, artifacts)
    title = F.try_element_at("payload", F.lit("title"))
    return rows_of({
        "overrides": (t["overrides"], ["domain", "raw_key", "canonical_key"]), "synonyms": (t["synonyms"], ["synonym", "canonical_key", "source"]), "failures": (t["failures"], ["domain", "reason", "occurrences"]),
        "identities": (t["identities"], ["product", "type", "value"]), "diffs": (t["diffs"].withColumn("title", title), ["diff_id", "status", "title"]), "tasks": (t["tasks"], ["task", "status"]), "to_apply": (t["to_apply"], ["diff_id"]),
    })


@query(
    "cluster_decisions",
    """
    SELECT o_orderkey AS task, CASE o_custkey % 4 WHEN 0 THEN 'edit' ELSE 'reject' END AS action, CASE o_custkey % 4 WHEN 0 THEN 'brand' END AS field, CASE o_custkey % 4 WHEN 1 THEN 'wrong_value' END AS reason
    FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 4 < 2
    """,
)
def cluster_decisions(spark, sf_dir):
    """Bulk decisions on clusters of open tasks: an edit, a rejection, an approval without an edit, none."""
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.lit("t").alias("tenant"), F.concat(F.lit("c"), (F.col("o_custkey") % 4).cast("string")).alias("cluster_key"), status.alias("status"))
    clusters = spark.createDataFrame([("t", "c0", "approve_all", "brand", "Acme"), ("t", "c1", "reject_all", None, None), ("t", "c2", "approve_all", None, None), ("u", "c3", "reject_all", None, None)], "tenant string, cluster_key string, action string, field string, value string")
    return V.cluster_decisions(clusters, tasks).select("task", "action", "field", "reason")


@query(
    "failure_counts",
    "SELECT 't' AS tenant, CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, 'wrong_value' AS reason, 10 + count(*) AS occurrences, max_by('n' || s_suppkey, s_suppkey) AS note FROM supplier GROUP BY 2",
)
def failure_counts(spark, sf_dir):
    """Stored failures with new ones counted in."""
    new = table(spark, sf_dir, "supplier").groupBy(F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd").alias("domain")).agg(F.count("*").alias("occurrences"), F.max_by(F.concat(F.lit("n"), F.col("s_suppkey").cast("string")), "s_suppkey").alias("note"))
    new = new.select(F.lit("t").alias("tenant"), "domain", F.lit("wrong_value").alias("reason"), "occurrences", "note", F.lit("title").alias("raw_key"), F.lit(2).alias("last_seen"))
    stored = spark.createDataFrame([("t", d, "wrong_value", 10, "old", "title", 1) for d in ("even", "odd")], new.schema)
    return V.with_counts(stored, new).select("tenant", "domain", "reason", "occurrences", "note")
