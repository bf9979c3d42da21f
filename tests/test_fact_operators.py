"""Pinned values of scalar functions, fact algebra, policy, resolution, pages, stores and streams."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions.jsonld import jsonld_facts
from factloom.functions import scalars as S
from factloom.operators import analytics as A
from factloom.operators import calibration as C
from factloom.operators import facts as X
from factloom.operators import policy as P
from factloom.operators import resolve as R
from factloom.sources import store
from factloom.streaming import events as E


def one(spark, column, **values):
    """The value of a column over one row."""
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "want"), [("MARTHA", "MARHTA", 0.961), ("DIXON", "DICKSONX", 0.813), ("JELLYFISH", "SMELLYFISH", 0.896), ("", "x", 0.0), ("Same", "same", 1.0)])
def test_jaro_winkler(spark, a, b, want):
    assert one(spark, S.jaro_winkler("a", "b"), a=a, b=b) == pytest.approx(want, abs=1e-3)


def test_scalars(spark):
    assert one(spark, S.gtin(F.col("a")), a="00-12 345") == "12345"
    assert one(spark, S.canonical_url(F.col("a")), a="HTTPS://Shop.Example.COM/p/?utm_x=1&id=2&ref=q&id=3#f") == "https://shop.example.com/p?id=2&id=3#f"
    assert one(spark, S.canonical_json("a"), a='{"b":1,"a":{"d":1,"c":2}}') == '{"a":{"c":2,"d":1},"b":1}'
    assert one(spark, S.strip_key("m")("a"), a='{"m":1,"x":[{"m":2,"y":3}]}') == '{"x":[{"y":3}]}'
    assert one(spark, S.to_canonical_unit(F.lit(2.0), F.col("a")), a="ft") == pytest.approx(60.96)
    assert one(spark, S.axis_name(F.col("a")), a="Colour Family (main)") in ("color", "colour_family_main")
    assert one(spark, S.axis_value(F.lit("size"), F.col("a")), a=" xl ") == "XL"
    assert one(spark, S.loose_number(F.col("a")), a="$1,299.00") == 1299.0


def test_isotonic(spark):
    s = spark.createDataFrame([("a", 0.5, o) for o in (0, 1, 1, 1)] + [("b", 0.95, int(i < 60)) for i in range(100)], "g string, raw double, outcome int")
    got = {r.g: r for r in C.refit(s, ["g"], least=4).collect()}
    assert got["a"].thresholds == [0.5] and got["a"]["values"] == [0.75] and got["b"]["values"] == [0.6]
    for raw, want in ((0.0, 0.2), (1.0, 0.8), (0.5, 0.5)):
        assert one(spark, C.apply_isotonic(F.lit(raw), F.array(*map(F.lit, (0.3, 0.6, 0.9))), F.array(*map(F.lit, (0.2, 0.5, 0.8))))) == want
    assert one(spark, C.apply_isotonic(F.lit(0.4), F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0.4


def test_psi(spark):
    def cohort(counts):
        return spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "k string")

    score = lambda b, c: A.psi(cohort(b), cohort(c), "k").first().psi
    assert score({"a": 30, "b": 50, "c": 20}, {"a": 30, "b": 50, "c": 20}) == 0
    assert 0.05 < score({"a": 30, "b": 50, "c": 20}, {"a": 45, "b": 35, "c": 20}) < 0.30
    assert score({"a": 90, "b": 5, "c": 5}, {"a": 5, "b": 90, "c": 5}) > 0.25
    assert score({"a": 3}, {"b": 3}) > 1


FACT = "page long, raw_key string, value string, confidence double, parser string, ordinal int"


def test_merge_and_payload(spark):
    rows = [(1, "title", "Chair", 0.65, "opengraph", 4), (1, "title", " chair ", 0.95, "json_ld", 0), (1, "title", "Sofa", 0.8, "microdata", 3), (1, "base_price", "10", 0.9, "nuxt", 5), (1, "base_price", "10.0000001", 0.95, "json_ld", 0), (1, "currency", "eur", 0.9, "json_ld", 1), (1, "color", "red", 0.5, "json_ld", 2), (1, "variants[0].price", "9", 0.9, "json_ld", 6), (1, "variants[0].option.size", "M", 0.9, "json_ld", 7)]
    facts = spark.createDataFrame(rows, FACT)
    got = {r.raw_key: r for r in X.merge_facts(facts).collect()}
    assert got["title"].value == " chair " and got["title"].alternatives == ["Sofa"]
    assert got["base_price"].parser == "json_ld" and got["base_price"].alternatives == []
    p = X.canonical_payload(facts).first()
    assert (p.title, p.basePrice, p.currency, p.attributes) == (" chair ", "10.0000001", "EUR", {"color": "red"})
    (v,) = X.variants(facts).collect()
    assert v.fields == {"price": "9"} and v.options == {"size": "M"}
    cross = {r.raw_key: r for r in X.cross_validate(facts).collect()}
    assert cross["title"].conflict and cross["title"].confidence == pytest.approx(0.83)
    assert not cross["base_price"].conflict and cross["base_price"].confidence == 1.0


def test_inferred_currency_and_gaps(spark):
    schema = "page long, raw_key string, value string, confidence double, parser string, ordinal int"
    facts = spark.createDataFrame([(1, "title", "a", 0.9, "json_ld", 0), (2, "title", "b", 0.9, "json_ld", 0), (2, "currency", "USD", 0.9, "json_ld", 1), (3, "title", "c", 0.9, "json_ld", 0), (5, None, None, 0.9, "json_ld", 0)], schema)
    pages = spark.createDataFrame([(1, "https://www.shop.co.uk/p"), (2, "https://shop.de/"), (3, None), (4, "https://x.in/"), (5, "http://y.se")], "page_id long, url string")
    got = X.infer_currency(facts, pages)
    assert {(r.page, r.value, r.confidence) for r in got.filter("parser = 'inferred'").collect()} == {(1, "GBP", 0.7), (4, "INR", 0.7), (5, "SEK", 0.7)}
    assert got.count() == 8
    site = spark.createDataFrame([(1, "title", "site", 0.9, "site", 0)], schema)
    assert {(r.page, r.raw_key, r.value) for r in X.fill_gaps(site, facts.filter("page < 3")).collect()} == {(1, "title", "site"), (2, "title", "b"), (2, "currency", "USD")}


def test_field_families(spark):
    want = {"variants[0].inventory_quantity": "inventory", "variants[3].price": "price", "variants[1].title": "variants", "sku": "identifier", "mrp": "price", "productType": "category", "images": "text", "category_path": "attribute"}
    for k, family in want.items():
        assert one(spark, X.field_family(F.col("k")), k=k) == family


DETECTOR_FACT = "array<struct<raw_key:string,value:string,unit:string,confidence:double,alternatives:array<string>>>"
DETECTED = f"title string, facts {DETECTOR_FACT}, price double, category string, category_confidence double, required array<string>, brand string, gtin string, model string, gtin_product string, gtin_brand string, mpn_product string, mpn_brand string, axes map<string,array<string>>, n_variants long, median_price double, samples long"


def product(facts=(), **changed):
    base = {"title": "t", "facts": [("title", "t", None, 0.9, []), ("base_price", "10", None, 0.9, []), *facts], "price": 10.0, "category": "c", "category_confidence": 0.9, "required": [], "brand": "B", "median_price": 9.0, "samples": 20, "n_variants": 0}
    return tuple((base | changed).get(name.split()[0]) for name in DETECTED.split(", "))


def test_route_and_detect(spark):
    rows = [
        product(gtin="12345678", gtin_product="p", gtin_brand=" b "),
        product([("weight", "5", "kg", 0.9, [])], price=60.0, gtin="123", gtin_product="p", gtin_brand="x"),
        product([("title", "t", None, 0.9, ["other", "T"])], required=["color"]),
        product([("color", "Pink", None, 0.9, [])], axes={"color": ["red", " PINK "]}, n_variants=2),
        product(title="", price=None, category=None, samples=9),
        (None,) * len(DETECTED.split(", ")),
    ]
    got = [r for r in P.route(P.detect(spark.createDataFrame(rows, DETECTED))).collect()]
    assert (got[0].decision, got[0].score, got[3].decision) == ("auto", 1.0, "auto")
    assert [s.kind for s in got[1].signals] == ["potential_duplicate", "price_anomaly", "value_contradiction"] and got[1].score == pytest.approx(0.05)
    assert [(s.kind, s.severity, s.field) for s in got[2].signals] == [("missing_required_attribute", "medium", "color"), ("field_conflict", "high", "title")]
    assert [(s.kind, s.field) for s in got[4].signals] == [("missing_required_attribute", "title"), ("category_ambiguous", None)]
    assert [s.kind for s in got[5].signals] == ["missing_required_attribute", "category_ambiguous"]
    assert one(spark, P.variants_are_incomplete(F.create_map(F.lit("size"), F.array(F.lit("s"), F.lit("m"))), F.lit(1))) is True


def test_resolution(spark):
    schema = "product long, gtin string, brand string, mpn string, title string, category string"
    known = spark.createDataFrame([(1, "0012345678", "Acme", "m1", "Blue chair", "home/chair"), (2, None, "acme", "m2", "Red lamp with a shade", "home/lamp"), (3, None, "acme", "m2", "Red lamp with a shade", "home/lamp"), (4, "555", "Acme", None, "x", "home")], schema)
    new = spark.createDataFrame([(10, "12345678", "ACME", None, "?", "home/chair"), (11, "12345678", "Other", None, "?", "home"), (12, "12345678", "Acme", None, "?", "toys"), (13, None, "Acme", "M2", "red lamp with a shade", None), (14, None, None, None, None, None)], schema)
    got = {r.candidate: r.action for r in R.dedupe(new, known).collect()}
    assert got == {10: "merge", 11: "review", 12: "conflict", 13: "review", 14: "new"}
    hit = {r.candidate: r.product for r in R.resolve_identity(R.identities(new), R.identities(known)).collect()}
    assert hit[10] == 1 and hit[12] == 1 and 14 not in hit
    pair = new.alias("a").join(known.alias("b"), F.col("a.gtin") == S.gtin(F.col("b.gtin"))).filter("a.product = 10")
    score = pair.select(R.match_score(R.pair_signals("a", "b")).alias("x")).first().x
    assert score == pytest.approx((0.40 + 0.15 + 0.25 * 0.0) / 0.80)
    assert one(spark, R.match_action(F.lit(0.7))) == "merge" and one(spark, R.match_action(F.lit(0.39))) == "keep_separate"


def test_similar_titles_are_reviewed(spark):
    schema = "product long, gtin string, brand string, mpn string, title string, category string"
    known = spark.createDataFrame([(1, "77", "Acme", "m1", "Smallredwidget", "home/chair"), (2, None, None, None, "Smallredwidget", "toys"), (3, None, None, None, "tiny", None)], schema)
    new = spark.createDataFrame([(10, None, None, None, " smallredwidgets", "home"), (11, "5", "B", "m9", "Smallredwodget", "toys"), (12, None, None, None, "Smallredwidget", "food"), (13, None, None, None, "small red widget", "toys"), (14, None, None, None, "TINY", "food"), (15, "77", "Acme", None, "Smallredwidget", "home"), (16, None, None, None, "smallredwidget", None), (17, None, None, None, None, None)], schema)
    got = {r.candidate: (r.action, r.product, r.by) for r in R.dedupe(new, known).collect()}
    assert got == {10: ("review", 1, "title"), 11: ("review", 2, "title"), 12: ("new", None, "none"), 13: ("new", None, "none"), 14: ("review", 3, "title"), 15: ("merge", 1, "gtin"), 16: ("review", 1, "title"), 17: ("new", None, "none")}


def test_title_classes_lose_no_pair(spark):
    titles = [f"{a} {b} {c}" for a in ("red", "reds", "blue") for b in ("chair", "chairs", "lamp") for c in ("with long wooden legs", "with long woodenlegs", "of steel and of glass")]
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(titles)], "id long, brand string, title string")

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j - 1] + (p != q), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    want = {frozenset((i, j)) for i, x in enumerate(titles) for j, y in enumerate(titles) if i < j and 1 - distance(x, y) / max(len(x), len(y)) >= 0.92 - 1e-9}
    got = {frozenset((r.id_a, r.id_b)) for r in R.title_classes(rows, "id", ["brand"], "title").collect()}
    assert got == want and want


def test_title_classes_need_no_common_word(spark):
    import random

    rng, titles = random.Random(3), ["customer#000000001", "customer#000000011", "customer#00000001", "x" * 12, "x" * 13, "abcdefghijkl", "abcdefghijk"]
    for n in (13, 24, 25, 26, 37, 38, 60, 75, 101):
        for _ in range(3):
            t = "".join(rng.choice("abcd ") for _ in range(n)).strip() or "a"
            titles.append(t)
            for edits in range(1, n // 12 + 2):
                other = list(t)
                for at in rng.sample(range(len(t)), edits):
                    other[at] = rng.choice(["", "é", other[at] + "z"])
                titles.append("".join(other).strip())
    titles = sorted(set(titles))
    rows = spark.createDataFrame([(i, "b", t) for i, t in enumerate(titles)], "id long, brand string, title string")
    a, b = rows.alias("a"), rows.alias("b")
    want = {(r.x, r.y) for r in a.join(b, F.col("a.id") < F.col("b.id")).filter(F.round(S.similarity(F.col("a.title"), F.col("b.title")), 9) >= 0.92).select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()}
    got = [(r.id_a, r.id_b) for r in R.title_classes(rows, "id", ["brand"], "title").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert (titles.index("customer#000000001"), titles.index("customer#000000011")) in want and len(want) > 40


def test_pages(spark):
    body = "x" * 6000
    html = f"""<html><head><title>Chair - Shop</title><meta property="og:title" content="A &amp; B chair"><script type="application/ld+json">[{{"@type":"Product","name":"Chair","brand":{{"name":"Acme"}},"gtin13":"123","offers":{{"price":"10","priceCurrency":"EUR"}}}}]</script>
    <script type="application/ld+json">not json</script></head><body><nav>menu</nav><h1>Big <b>chair</b></h1><p>See <a href="/a">this</a></p><!-- no --><span itemprop="sku">S1</span><meta itemprop="price" content="10">{body}</body></html>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "are you human?"), (4, "")], "page_id long, html string")
    facts = {(r.parser, r.raw_key): r.value for r in jsonld_facts(pages).union(H.property_facts(pages)).collect()}
    assert facts[("json_ld", "brand")] == "Acme" and facts[("json_ld", "gtin")] == "123" and facts[("json_ld", "base_price")] == "10"
    assert facts[("microdata", "mpn")] == "S1" and facts[("microdata", "base_price")] == "10" and facts[("opengraph", "title")] == "A & B chair"
    got = {r.page_id: r for r in pages.select("page_id", H.clean(F.col("html")).alias("t"), H.page_title(F.col("html")).alias("title"), H.captcha_wall(F.col("html")).alias("wall")).collect()}
    assert "this (/a)" in got[1].t and "menu" not in got[1].t and "Big chair" in got[1].t.replace("  ", " ") and got[1].title.confidence == 0.85
    assert got[3].wall and not got[1].wall and got[2].t is None
    gaps = H.coverage(jsonld_facts(pages).select("page", "raw_key"), ["material"]).first().gaps
    assert gaps == ["material", "productType"]
    crumbs = F.array(F.struct(F.lit(2).alias("position"), F.lit("Chairs").alias("name")), F.struct(F.lit(1).alias("position"), F.lit("Home").alias("name")), F.struct(F.lit(None).cast("int").alias("position"), F.lit("This").alias("name")))
    assert one(spark, H.breadcrumb(crumbs)) == "home/chairs"


def test_stores(spark, tmp_path):
    stored = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, m string, v int")
    new = spark.createDataFrame([("a", None, 5), ("b", "y", 6), ("b", "y", 6)], "k string, m string, v int")
    assert [(r.k, r.m) for r in store.absent(new, stored, ["k", "m"]).collect()] == [("b", "y")]
    diffs = spark.createDataFrame([(1, "approved"), (2, "open")], "diff_id int, status string")
    assert store.approved_only(spark.createDataFrame([(1, "v"), (2, "w")], "diff_id int, v string"), diffs).count() == 1
    assert store.current(spark.createDataFrame([("p", 1, "old"), ("p", 2, "new")], "p string, n int, v string"), "p", ["n"]).first().v == "new"
    (tmp_path / "a.csv").write_text("sku,title,attributes.color\n1,Chair,red\n2,,\n")
    rows = store.read_csv(spark, str(tmp_path / "a.csv"), ["sku", "title"], []).orderBy("sku").collect()
    assert rows[0].attributes == {"color": "red"} and rows[0].errors == [] and rows[1].errors == ["title is empty"]
    assert [r.row for r in rows] == [1, 2]
    for wrong in ({"required": ["sku", "price"]}, {"most_rows": 1}, {"most_bytes": 10}, {"optional": []}):
        args = {"required": ["sku"], "optional": ["title"]} | wrong
        with pytest.raises(ValueError):
            store.read_csv(spark, str(tmp_path / "a.csv"), **args)


def run_stream(spark, tmp_path, make, schema, files, mode="append"):
    """Rows a stream gives for files of rows, one file to a batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = out.writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").queryName(f"q{i}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q = q.start(str(tmp_path / "out")) if mode == "append" else q.start()
        q.awaitTermination()


T = datetime.datetime(2024, 1, 1, 10)


def test_webhooks_once(spark, tmp_path):
    rows = [("a", T), ("a", T), ("b", T)]
    run_stream(spark, tmp_path, E.webhooks_once, "body string, ts timestamp", [rows, [("a", T), ("c", T)]])
    assert sorted(r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_hourly_health_stream(spark, tmp_path):
    rows = [(T, "d", "p", True), (T, "d", "p", False), (T + datetime.timedelta(hours=5), "d", "p", True)]
    run_stream(spark, tmp_path, E.hourly_health, "ts timestamp, domain string, parser string, success boolean", [rows, [(T + datetime.timedelta(hours=9), "d", "p", True)]])
    got = [(r.fired, r.success) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window").collect()]
    assert got[0] == (2, 1)


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        E.append_new(batch, path, ["k"])
    assert spark.read.parquet(path).count() == 2
