"""Site pages, marketplace records, shop JSON, model answers and webhooks, dealt to the rows of tables."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import records as R
from factloom.functions import sites as T
from factloom.operators import models as M
from factloom.plans import fixtures as X
from factloom.plans.fixtures import dealt, values
from factloom.plans.register import query
from factloom.sources import record_pages as D
from factloom.sources.tables import shared_path, table
from factloom.streaming import events as E


def numbered(lists: list[list[tuple]]) -> list[tuple]:
    return [(i, *row) for i, rows in enumerate(lists) for row in rows]


def dealt_pages(spark, sf_dir):
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", dealt([p[0] for p in X.SITE_PAGES], key).alias("url"), dealt([p[1] for p in X.SITE_PAGES], key).alias("html"))


@query("site_facts", f"SELECT page_id AS page, raw_key, value, confidence FROM pages JOIN {values(numbered([p[2] for p in X.SITE_PAGES]), 'm, raw_key, value, confidence')} ON page_id % {len(X.SITE_PAGES)} = m")
def site_facts(spark, sf_dir):
    return T.site_facts(dealt_pages(spark, sf_dir)).select("page", "raw_key", "value", "confidence")


@query("site_registry", "SELECT page_id AS page, CASE page_id % 7 WHEN 0 THEN 'amazon' WHEN 1 THEN 'ebay' WHEN 2 THEN 'walmart' WHEN 3 THEN 'croma' WHEN 4 THEN 'bestbuy' ELSE 'amazon' END AS site FROM pages WHERE page_id % 7 <> 5")
def site_registry(spark, sf_dir):
    return T.site_of(dealt_pages(spark, sf_dir))


def dealt_records(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("external_id"), F.lit("shopify").alias("marketplace"), dealt([r[0] for r in X.RECORDS], key).alias("raw"))


@query("record_facts", f"SELECT p_partkey AS external_id, raw_key, value, confidence, method FROM part JOIN {values(numbered([r[1] for r in X.RECORDS[:2]]) + [(2, 'title', 'no id', 1.0, 'direct')], 'm, raw_key, value, confidence, method')} ON p_partkey % {len(X.RECORDS)} = m")
def record_facts(spark, sf_dir):
    return R.extract_records(dealt_records(spark, sf_dir)).select("external_id", "raw_key", "value", "confidence", "method")


@query("record_norm", f"SELECT p_partkey, CASE p_partkey % {len(X.RECORDS)} WHEN 0 THEN 'r0' ELSE 'r1' END AS external_id, CASE p_partkey % {len(X.RECORDS)} WHEN 0 THEN TIMESTAMP '2026-01-02 03:04:05' END AS modified_at, false AS has_metadata FROM part WHERE p_partkey % {len(X.RECORDS)} < 2")
def record_norm(spark, sf_dir):
    """Records without their sync's metadata, by the part they were dealt to."""
    raw = dealt_records(spark, sf_dir).withColumn("raw", F.regexp_replace("raw", r"^\{", F.concat(F.lit('{"part":'), F.col("external_id").cast("string"), F.lit(","))))
    good = R.normal_records(raw.select("raw"))
    return good.select(F.get_json_object("raw", "$.part").cast("long").alias("p_partkey"), "external_id", "modified_at", F.col("raw").contains("_nango_metadata").alias("has_metadata"))


@query("record_inventory", f"SELECT p_partkey AS external_id, location, available FROM part JOIN {values(numbered([r[2] for r in X.RECORDS]), 'm, location, available')} ON p_partkey % {len(X.RECORDS)} = m")
def record_inventory(spark, sf_dir):
    return R.inventory(dealt_records(spark, sf_dir))


_N = len(X.SHOP_JSON)


@query("shop_probe_facts", f"SELECT page_id, raw_key, value, 0.95 AS confidence FROM pages JOIN {values(numbered([s[2] for s in X.SHOP_JSON]), 'm, raw_key, value')} ON page_id % {_N} = m")
def shop_probe_facts(spark, sf_dir):
    json = dealt([s[1] for s in X.SHOP_JSON], F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(R.probe_facts(json)).alias("f")).select("page_id", "f.raw_key", "f.value", "f.confidence")


@query("shop_json_facts", f"SELECT page_id, raw_key, value, 0.95 AS confidence FROM pages JOIN {values(numbered([s[3] for s in X.SHOP_JSON]), 'm, raw_key, value')} ON page_id % {_N} = m")
def shop_json_facts(spark, sf_dir):
    url, json = (dealt([s[i] for s in X.SHOP_JSON], F.col("page_id")) for i in (0, 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(R.products_json_facts(url, json)).alias("f")).select("page_id", "f.raw_key", "f.value", "f.confidence")


def dealt_answers(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), dealt([a[0] for a in X.ANSWERS], F.col("page_id")).alias("content"))


_ANSWERS = f"SELECT page_id AS page, raw_key, value, confidence FROM pages JOIN {values(numbered([a[1] for a in X.ANSWERS]), 'm, raw_key, value, confidence')} ON page_id % {len(X.ANSWERS)} = m"


@query("llm_facts", _ANSWERS)
def llm_facts(spark, sf_dir):
    return M.answer_facts(dealt_answers(spark, sf_dir)).select("page", "raw_key", "value", "confidence")


@query("gap_fill", f"SELECT * FROM ({_ANSWERS}) WHERE raw_key = 'title' OR (page % 4 = 0 AND raw_key IN ('currency', 'volume'))")
def gap_fill(spark, sf_dir):
    """Of the answers' facts those that fill a page's gaps."""
    gaps = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.when(F.col("page_id") % 4 == 0, F.array(F.lit("title"), F.lit("currency"), F.lit("volume"))).otherwise(F.array(F.lit("title"))).alias("gaps"))
    return M.wanted_gaps(M.answer_facts(dealt_answers(spark, sf_dir)), gaps).select("page", "raw_key", "value", "confidence")


@query("vision_facts", "SELECT page_id AS page, 'weight' AS raw_key, (page_id % 10)::VARCHAR AS value, 0.7 AS confidence FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'colour', 'red', 0.7 FROM pages WHERE page_id % 3 <> 1")
def vision_facts(spark, sf_dir):
    n = (F.col("page_id") % 10).cast("string")
    content = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"weight":'), n, F.lit(',"colour":"red","size":null,"fit":""}'))).when(F.col("page_id") % 3 == 2, '{"colour":"red"}').otherwise("none")
    return M.vision_facts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), content.alias("content"))).select("page", "raw_key", "value", "confidence")


@query(
    "llm_cost",
    """
    SELECT user_id, round(sum((event_id % 5000 * i + event_id % 700 * o) / 1000000.0), 9) AS cost_usd, count(*) AS calls
    FROM events JOIN (VALUES (0, 0.15, 0.60), (1, 0.59, 0.79), (2, 0.05, 0.08), (3, 1.0, 3.0)) p(m, i, o) ON event_id % 4 = m GROUP BY user_id
    """,
)
def llm_cost(spark, sf_dir):
    model = dealt(["gpt-4o-mini", "llama-3.3-70b-versatile", "llama-3.1-8b-instant", "unheard-of"], F.col("event_id"))
    cost = M.cost_usd(model, F.col("event_id") % 5000, F.col("event_id") % 700)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum(cost), 9).alias("cost_usd"), F.count("*").alias("calls"))


@query(
    "vision_escalation",
    """
    WITH p AS (SELECT page_id, page_id % 4 AS m, page_id % 3 = 0 AS priced, page_id % 7 AS n FROM pages),
         r AS (SELECT *, list_filter([CASE WHEN m = 0 THEN 'size_chart_image' END, CASE WHEN m = 1 THEN 'spec_graphic_image' END, CASE WHEN m = 2 AND NOT priced THEN 'image_rendered_price' END,
                                      CASE WHEN m = 2 AND NOT priced AND n < 3 THEN 'no_text_price_with_image_carousel' END], lambda x: x IS NOT NULL) AS reasons FROM p)
    SELECT page_id, array_to_string(reasons, '|') AS reasons, len(reasons) > 0 AND (n < 5 OR NOT priced) AS to_vision FROM r
    """,
)
def vision_escalation(spark, sf_dir):
    html = F.concat("html", dealt(['<img src="/size-chart.png">', '<img class="spec_image">', '<div class="product-gallery"><img src="sale-banner.png"></div>', "<p>text</p>"], F.col("page_id")))
    args = (html, F.col("page_id") % 3 == 0, F.col("page_id") % 7)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(M.vision_reasons(*args), "|").alias("reasons"), M.to_vision(*args).alias("to_vision"))


@query(
    "cost_ceiling",
    """
    SELECT event_id, coalesce(sum(event_id % 40) OVER w, 0)::BIGINT AS spent, (coalesce(sum(event_id % 40) OVER w, 0) + event_id % 40) * 0.0001 <= 0.05 AS allowed
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    """,
)
def cost_ceiling(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 40).alias("credits"))
    return M.affordable(calls, ["user_id"], ["event_id"]).select("event_id", "spent", "allowed")


@query("source_reliability", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 0.65 ELSE greatest(0.0, least(1.0, s_acctbal / 5000)) END AS reliability FROM supplier")
def source_reliability(spark, sf_dir):
    avg = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal") / 5000)
    return table(spark, sf_dir, "supplier").select("s_suppkey", M.source_reliability(avg).alias("reliability"))


_SECRETS = ["first secret", "second " * 12]
_BODIES = [
    '{"type":"sync","syncType":"FULL","syncName":"s","model":"m","connectionId":"c","providerConfigKey":"p","startedAt":"2024-01-01T00:00:00Z"}',
    '{"type":"auth","operation":"creation","success":true,"connectionId":"c","providerConfigKey":"p","provider":"x"}',
    '{"type":"auth","operation":"deletion","success":true,"connectionId":"c","providerConfigKey":"p","provider":"x"}',
    '{"type":"sync","syncType":"FULL","syncName":"s","model":"m","connectionId":"c","providerConfigKey":"p"}',
    "{",
]
_SIGNED = [hmac.new(_SECRETS[i % 2].encode(), b.encode(), hashlib.sha256).hexdigest() for i, b in enumerate(_BODIES)]


@query(
    "webhooks",
    f"""
    WITH e AS (SELECT event_id, event_id % 5 AS m, event_id % 11 = 0 AS forged, epoch(ts - TIMESTAMP '2024-01-01') AS age FROM events),
         b AS (SELECT * FROM e JOIN {values([(i, hashlib.sha256(b.encode()).hexdigest()) for i, b in enumerate(_BODIES)], 'k, webhook_id')} ON m = k)
    SELECT event_id, webhook_id, CASE WHEN forged THEN 'invalid_signature' WHEN m IN (2, 4) THEN 'invalid_payload' WHEN m = 0 AND floor(age) > 300 THEN 'stale' END AS error,
           CASE WHEN forged OR m IN (2, 4) OR (m = 0 AND floor(age) > 300) THEN 'none' WHEN m = 1 THEN 'auth' ELSE 'sync' END AS queue
    FROM b
    """,
)
def webhooks(spark, sf_dir):
    """Webhooks with signatures of either secret or forged ones, checked and routed by type."""
    signature = F.when(F.col("event_id") % 11 == 0, "0" * 64).otherwise(dealt(_SIGNED, F.col("event_id")))
    raw = table(spark, sf_dir, "events").select("event_id", "ts", dealt(_BODIES, F.col("event_id")).alias("body"), signature.alias("signature"))
    checked = E.webhooks(raw, _SECRETS)
    return checked.select("event_id", "webhook_id", "error", E.queue_of(F.col("event"), F.col("error")).alias("queue"))


@query(
    "rung_share_jumps",
    """
    WITH s AS (SELECT date_trunc('day', ts) AS start, event_type AS domain, count(*) AS fired, avg((user_id % 3 = 0 AND event_id % 5 < day(ts) % 4)::INT) AS share FROM events GROUP BY 1, 2),
         l AS (SELECT *, lag(share) OVER (PARTITION BY domain ORDER BY start) AS was FROM s)
    SELECT start, domain, fired, round(share, 9) AS share FROM l WHERE was <= 0.05 AND share >= 0.15
    """,
)
def rung_share_jumps(spark, sf_dir):
    rung = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 5 < F.dayofmonth("ts") % 4), "llm").otherwise("rules")
    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("domain"), rung.alias("rung"))
    return E.jumps(rows, after=0.15, width="1 day").select("start", "domain", "fired", F.round("share", 9).alias("share"))


@query(
    "record_drain",
    """
    WITH r AS (SELECT p_brand AS connection, p_partkey AS id, p_name AS title, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (p_partkey // 7), '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM part),
    n AS (SELECT *, (row_number() OVER (PARTITION BY connection ORDER BY updated_at, id::VARCHAR) - 1) // 50 AS page FROM r)
    SELECT connection, page::INT AS page, updated_at, id::VARCHAR AS external_id, title FROM n WHERE updated_at > '2024-01-01T00:00:30Z'
    """,
)
def record_drain(spark, sf_dir):
    """Parts as records of their brands' shops, paged, and drained from a time on."""
    at = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.expr("p_partkey div 7")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    raw = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), at.alias("updated_at")))
    records = table(spark, sf_dir, "part").select(F.col("p_brand").alias("connection"), at.alias("updated_at"), F.col("p_partkey").cast("string").alias("external_id"), raw.alias("raw"))
    D.write_pages(records, path := shared_path(spark, "record-pages"))
    return D.drain(spark, path, "2024-01-01T00:00:30Z").select("connection", "page", "updated_at", "external_id", F.get_json_object("raw", "$.title").alias("title"))


@query(
    "single_flight",
    """
    WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM (SELECT DISTINCT user_id, ts FROM events)),
    f AS (
      SELECT key, ts, n, ts AS held, true AS admitted FROM e WHERE n = 1
      UNION ALL
      SELECT e.key, e.ts, e.n, CASE WHEN e.ts - f.held >= INTERVAL 600 MINUTE THEN e.ts ELSE f.held END, e.ts - f.held >= INTERVAL 600 MINUTE FROM f JOIN e ON e.key = f.key AND e.n = f.n + 1)
    SELECT key, ts, admitted FROM f
    """,
)
def single_flight(spark, sf_dir):
    """Triggers of users, of which one in ten hours may run."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts").distinct()
    return E.single_flight(rows, minutes=600).select("key", "ts", "admitted")


_TO = ["active", "refresh_failing", "revoked", "active", "pending_failed"]


@query(
    "connection_states",
    f"""
    WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS connection, ts, to_, row_number() OVER (PARTITION BY user_id ORDER BY ts, to_) AS n FROM events JOIN {values(list(enumerate(_TO)), 'm, to_')} ON event_id % {len(_TO)} = m),
    allowed AS (SELECT * FROM {values([(a, b) for a, all_ in E.TRANSITIONS.items() for b in all_], 'a, b')}),
    f AS (
      SELECT connection, ts, n, CASE WHEN EXISTS (SELECT 1 FROM allowed WHERE a = 'pending' AND b = to_) THEN to_ ELSE 'pending' END AS state, (NOT EXISTS (SELECT 1 FROM allowed WHERE a = 'pending' AND b = to_))::BIGINT AS rejected FROM e WHERE n = 1
      UNION ALL
      SELECT e.connection, e.ts, e.n, CASE WHEN b IS NULL THEN f.state ELSE e.to_ END, f.rejected + (b IS NULL)::BIGINT
      FROM f JOIN e ON e.connection = f.connection AND e.n = f.n + 1 LEFT JOIN allowed ON a = f.state AND b = e.to_)
    SELECT connection, ts, state, rejected FROM f
    """,
)
def connection_states(spark, sf_dir):
    """Users as connections, and their events as changes of state."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("connection"), "ts", dealt(_TO, F.col("event_id")).alias("to"))
    return E.connection_states(rows)


_ENDS = ["<p>are you human?</p>", '<script type="application/ld+json">{}</script>', "<script>window.__NUXT__={}</script>", "<p>plain</p>"]


@query(
    "coverage_tier",
    f"""
    WITH p AS (SELECT page_id, html || e AS html FROM pages JOIN {values(list(enumerate(_ENDS)), 'm, e')} ON page_id % {len(_ENDS)} = m)
    SELECT page_id, CASE WHEN length(html) < 10000 AND regexp_matches(html, '(?i)captcha|robot check|are you human|access denied|pardon our interruption') THEN 0.1
      WHEN contains(lower(html), 'application/ld+json') THEN 0.8 WHEN contains(html, '__NEXT_DATA__') OR contains(html, '__NUXT__') THEN 0.7 ELSE 0.3 END::DOUBLE AS tier FROM p
    """,
)
def coverage_tier(spark, sf_dir):
    """Pages, each with an end of one of several kinds."""
    html = F.concat("html", dealt(_ENDS, F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", H.coverage_tier(html).alias("tier"))
