"""Pages of sites, records, webhooks and streams: cases beyond the queries'."""

import datetime
import hashlib
import hmac
import json
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import records as R
from factloom.functions import sites as T
from factloom.functions.dom import dom_facts
from factloom.functions.inline import inline_facts
from factloom.functions.jsonld import jsonld_facts
from factloom.functions.tree import read
from factloom.operators import models as M
from factloom.operators import review as V
from factloom.streaming import events as E

NOW = datetime.datetime(2024, 1, 1, 10)


def texts(root, selector):
    return [e.text() for e in root.select(selector)]


def test_tree_and_selectors():
    root = read('<div id=a class="x y"><p>one<br>two <b>three</b></p><p class=z>four</div><ul><li>1<li>2</ul></b><span data-k="v">s</span><i data-k>t</i>')
    assert texts(root, "#a p") == ["onetwo three", "four"] and texts(root, "p.z, b") == ["three", "four"]
    assert texts(root, "div.x.y b") == ["three"] and texts(root, "[data-k='v']") == ["s"] and texts(root, "[data-k]") == ["s", "t"]
    assert texts(root, ".none p") == [] and texts(root, "#a p:last-child") == ["four"]
    assert read(None).text() == "" and read("<" * 50).select("p") == []


def test_site_pages(spark):
    assert T.facts_of("walmart", "https://www.walmart.com/ip/a/1", '<script id="__NEXT_DATA__">{broken</script><h1 itemprop="name">Shown</h1><b data-automation-id="product-price">$5</b>') == [("product_id", "1", 1.0), ("title", "Shown", 0.85), ("base_price", "5", 0.8), ("currency", "USD", 0.75)]
    assert T.facts_of("ebay", "https://www.ebay.com/itm/12", None) == []
    pages = spark.createDataFrame([(1, "https://amazon.com/dp/B0ABCDEFGH", None), (2, None, "x"), (None, "https://notamazon.com/dp/B0ABCDEFGH", "x"), (4, "https://a.b.croma.com/x/p/7", "<h1 class='pd-title'>P</h1>")], "page_id long, url string, html string")
    got = {(r.page, r.raw_key, r.value, r.parser) for r in T.site_facts(pages).collect()}
    assert got == {(1, "asin", "B0ABCDEFGH", "per_site_parser:amazon"), (4, "sku", "7", "per_site_parser:croma"), (4, "title", "P", "per_site_parser:croma")}
    assert T.site_facts(pages.limit(0)).count() == 0


def test_application_states():
    deep = {"name": "deep", "price": 1, "sku": "s"}
    for _ in range(9):
        deep = {"x": deep}
    assert R.next_facts_of(json.dumps(deep)) == [] and R.next_facts_of("[1]") == [] and R.next_facts_of(None) == []
    two = {"a": {"name": "A", "price": "x", "sku": "1"}, "b": [{"title": "B", "mrp": "10", "listPrice": 12, "color": {"name": "red"}}, {"name": "C", "price": 1, "brand": "b", "sku": 2}]}
    assert R.next_facts_of(json.dumps(two)) == [("title", "B"), ("mrp", "10"), ("color", "red")]  # four keys each: the first


def test_records(spark):
    rows = spark.createDataFrame([("1", "{broken"), ("2", None), ("3", '{"variants":[{"price":"x"},{"sku":" "}]}')], "external_id string, raw string")
    assert R.record_facts(rows).count() == 0 and R.inventory(rows).filter("external_id = '3'").count() == 2
    with pytest.raises(ValueError, match="no extractor"):
        R.extract_records(rows.withColumn("marketplace", F.lit("other")))
    good = spark.createDataFrame([('{"id":1,"a":{"_nango_metadata":1,"b":[{"_nango_metadata":2,"c":3}]}}',), ('{"a":1}',)], "raw string")
    (r,) = R.normal_records(good).collect()
    assert (r.external_id, r.modified_at, json.loads(r.raw)) == ("1", None, {"id": 1, "a": {"b": [{"c": 3}]}}) and R.missing_id(good).count() == 1


def test_hostile_pages_end(spark):
    """Elements that never end, over and over: time in proportion to the page."""
    bad = "<script type='application/ld+json'>" * 8000 + "<nav><a href='x'><!-- " * 8000 + "<h1 class='price description breadcrumb'>" * 3000 + "</script>"
    pages = spark.createDataFrame([(1, "http://x", bad), (2, "http://x", "<p>" * 1_500_000)], "page_id long, url string, html string")
    began = time.time()
    pages.select(F.sum(F.length(H.clean(F.col("html"))))).collect()
    for facts in (H.property_facts(pages), jsonld_facts(pages), inline_facts(pages), dom_facts(pages)):
        facts.count()
    assert time.time() - began < 90


def test_jsonld_choices(spark):
    blocks = [
        '{"@type":"Product","name":"first","offers":null}', '{"@type":"Product","name":"offered","offers":{"@type":"AggregateOffer","offers":[{"price":"1","priceCurrency":"USD"},{"price":"2","priceCurrency":"AUD"}]}}',
        '{"@type":"Product","name":"sized","size":["S","M"]}', "{bad", '[{"@type":"Thing"}]',
    ]
    page = lambda own: "".join(f'<script type="application/ld+json">{b}</script>' for b in own)
    rows = [(1, "https://x.com.au/", page(blocks)), (2, "https://x.com.au/", page(blocks[:2])), (3, None, page(blocks[:1])), (4, None, page(blocks[3:])), (5, None, None)]
    got = {}
    for r in jsonld_facts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page, {})[r.raw_key] = r.value
    assert got == {1: {"title": "sized", "variants[0].option.size": "S", "variants[1].option.size": "M"}, 2: {"title": "offered", "base_price": "2", "currency": "AUD"}, 3: {"title": "first"}}


def test_webhooks(spark):
    body = json.dumps({"type": "sync", "syncType": "FULL", "syncName": "s", "model": "m", "connectionId": "c", "providerConfigKey": "p", "startedAt": "2024-01-01T09:58:00Z"})
    sign = lambda text, secret: hmac.new(secret.encode(), text.encode(), hashlib.sha256).hexdigest()
    odd = body.replace("FULL", "HALF")
    rows = [(body, sign(body, "a"), NOW), (body, sign(body, "b" * 70), NOW), (body, sign(body, "c"), NOW), (body, None, NOW), (odd, sign(odd, "a"), NOW), (body, sign(body, "a"), NOW + datetime.timedelta(minutes=4)), (None, None, NOW)]
    out = E.webhooks(spark.createDataFrame(rows, "body string, signature string, ts timestamp"), ["a", "b" * 70])
    assert [r.error for r in out.collect()] == [None, None, "invalid_signature", "invalid_signature", "invalid_payload", "stale", "invalid_signature"]
    assert E.by_type(out)["sync"].count() == 2 and E.by_type(out)["auth"].count() == 0


def test_records_resume_where_a_run_ended(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": i}))
        q = E.records_since(spark, str(tmp_path / "in"), "id long", 1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_answers_of_odd_kinds(spark):
    rows = [(1, '{"title":"A","category_confidence":2}'), (2, '{"title":"A","_field_confidence":{"title":1.5}}'), (3, '["title"]'), (4, None), (5, '{"title":"","error":"none"}'), (6, "{}")]
    assert M.answer_facts(spark.createDataFrame(rows, "page long, content string")).count() == 0


def test_tasks_without_parts(spark):
    tasks = spark.createDataFrame([(1, None, None)], "task int, diff_id int, artifact int")
    none = lambda schema: spark.createDataFrame([], schema)
    (r,) = V.tasks_with_diffs(tasks, none("diff_id int, s string"), none("diff_id int, f string"), none("artifact int, u string")).collect()
    assert r.diff is None and r.fields == [] and r.artifact_row is None


def test_long_site_pages_give_what_the_url_tells(spark):
    from factloom.functions import sites

    url = "https://www.amazon.in/dp/B000TEST00"
    page = "<span id='productTitle'>A lamp</span>"
    rows = [(i, url, page) for i in range(70)] + [(90, url, page + "<p>" * 1_500_000), (91, url, None)]
    got = {}
    for r in sites.site_facts(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect():
        got.setdefault(r.page, []).append((r.raw_key, r.value))
    assert len(got) == 72 and got[90] == got[91] and len(got[91]) == 1 and all(got[i] == got[0] and len(got[0]) > 1 for i in range(70))
