"""Facts from platforms' scripts and classes, over pages written for the purpose."""

import json

from factloom.functions import inline


def facts(spark, html, *more):
    rows = inline.inline_facts(spark.createDataFrame([(i, h) for i, h in enumerate([html, *more])], "page_id long, html string")).collect()
    return {(r.page, r.parser, r.raw_key): r.value for r in rows}


def test_states(spark):
    product = {"title": "Tent", "name": None, "vendor": "Acme", "price": "", "sellingPrice": 5, "barcode": "123", "model": " ", "attributes": {"color": "red", "seats": 4, "tags": ["a"], "none": None, "wet": True}}
    nuxt = f"<script>window.__NUXT__ = {json.dumps({'payload': {'product': 1, 'data': {'product': product}}})};</script>"
    state = f"<script>window.__PRELOADED_STATE__={json.dumps({'state': {'product': {'name': 'Lamp', 'sellingPrice': '12.5', 'brand': {'name': 'x'}}}})}</script>"
    got = facts(spark, nuxt, state, "<script>window.__NUXT__={broken</script>", None, "")
    assert got == {
        (0, "nuxt", "title"): "Tent", (0, "nuxt", "brand"): "Acme", (0, "nuxt", "gtin"): "123", (0, "nuxt", "color"): "red", (0, "nuxt", "seats"): "4", (0, "nuxt", "wet"): "true",
        (1, "initial_state", "title"): "Lamp", (1, "initial_state", "base_price"): "12.5",
    }


def test_first_hit(spark):
    data = {"hits": [{"name": "Boot", "price": 59.9, "sku": "B-1"}, {"name": "Shoe"}]}
    got = facts(spark, f'<script id="__ALGOLIA_DATA__" type="application/json">{json.dumps(data)}</script>', '<script id="__ALGOLIA_DATA__">{"hits": []}</script>')
    assert got == {(0, "algolia", "title"): "Boot", (0, "algolia", "base_price"): "59.9", (0, "algolia", "model_number"): "B-1"}


def test_init_scripts(spark):
    box = {"[data-role=priceBox]": {"Magento_Catalog/js/price-box": {"priceConfig": {"prices": {"finalPrice": {"amount": "n/a"}, "regularPrice": {"amount": 20}}, "productPrice": {"amount": 30}}}}}
    view = {"*": {"Magento_Catalog/product/view": {"name": "Mug", "sku": "M1", "price": 99}, "other": 3}, "#x": "text"}
    script = '<script type="text/x-magento-init">{}</script>'
    got = facts(spark, script.format(json.dumps(box)) + script.format("{bad") + script.format(json.dumps(view)), script.format(json.dumps(view)))
    assert got[0, "magento", "base_price"] == "20"
    assert got[0, "magento", "title"] == "Mug" and got[0, "magento", "model_number"] == "M1"
    assert got[1, "magento", "base_price"] == "99"


def test_single_product(spark):
    body = '<div class="type-product product" data-product_sku="K9" data-product_id="77"><h1 class="product_title entry">Kettle &amp; lid</h1>{}</div>'
    plain = '<span class="woocommerce-Price-amount amount">$1,299.50</span>'
    nested = '<span class="woocommerce-Price-amount amount"><bdi><span class="symbol">&#36;</span>15.00</bdi></span>'
    pages = [f'<body class="woo {c}">{body.format(p)}</body>' for c, p in (("single-product", plain), ("single-product", nested), ("shop", plain))]
    got = facts(spark, *pages)
    assert {k[2]: v for k, v in got.items() if k[0] == 0} == {"title": "Kettle & lid", "base_price": "1299.50", "model_number": "K9", "sku": "77"}
    assert got[1, "woocommerce", "base_price"] == "15.00"
    assert not [k for k in got if k[0] == 2]


def test_walls_give_nothing(spark):
    assert not facts(spark, 'captcha <script id="__ALGOLIA_DATA__">{"hits": [{"name": "Boot"}]}</script>')


def test_product_properties(spark):
    head = '<meta property="name" content="Site">'
    item = '<div typeof="schema:Product"><span property="schema:name">Red <b>chair</b></span><span property="name">Other</span><meta property="price" content="49.5"><i property="gtin8">12</i><i property="colour">x</i></div>'
    got = facts(spark, head + item, head + item.replace("49.5", "ask"), head)
    assert got == {(0, "rdfa", "title"): "Red chair", (0, "rdfa", "base_price"): "49.5", (0, "rdfa", "gtin"): "12", (1, "rdfa", "title"): "Red chair", (1, "rdfa", "gtin"): "12"}
