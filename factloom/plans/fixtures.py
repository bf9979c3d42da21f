"""Small pages, records and answers that queries deal to the rows of a table, and what is to be found in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dealt(texts: list[str], key: Column) -> Column:
    """The text of texts whose number is key modulo their number."""
    return F.get(F.array(*[F.lit(t) for t in texts]), F.pmod(key, F.lit(len(texts))).cast("int"))


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SQL table of rows."""
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({names})"


#: Ends of pages, and of each (raw key, value, parser, confidence, alternatives).
PAGE_ENDS = [
    (
        """<script type="application/ld+json">[{"@type":"BreadcrumbList","itemListElement":[{"name":"Home","position":1},{"name":"Shoes","position":2},{"name":"Trail Runner Mk II","position":3}]},
        {"@type":"Product","name":"Trail Runner Mk II for men","brand":{"name":"Acme"},"gtin13":"4006381333931","additionalProperty":[{"name":"Sole Type","value":"Rubber"}],"offers":[{"price":"99.50","priceCurrency":"USD"},{"price":89,"priceCurrency":"EUR"}],"image":["http://x/a.jpg"]}]</script>
        <meta property="og:title" content="Runner"><meta property="product:price:currency" content="usd">""",
        [
            ("title", "Trail Runner Mk II for men", "json_ld", 0.95, "Runner"), ("brand", "Acme", "json_ld", 0.95, ""), ("gtin", "4006381333931", "json_ld", 0.95, ""), ("sole_type", "Rubber", "json_ld", 0.95, ""), ("base_price", "99.5", "json_ld", 0.95, ""),
            ("currency", "USD", "json_ld", 0.95, ""), ("images", '["http://x/a.jpg"]', "json_ld", 0.95, ""), ("productType", "Home/Shoes", "json_ld", 0.95, ""), ("category_path", "home/shoes", "breadcrumb_list", 0.7, ""),
        ],
    ),
    (
        """<script type="application/ld+json">{"@type":"ProductGroup","name":"Shirt","hasVariant":[{"color":"Red","size":"M","sku":"a1","gtin14":"10012345678902","offers":{"price":12}},{"color":"Blue","sku":"a2"}]}</script>""",
        [
            ("title", "Shirt", "json_ld", 0.95, ""), ("variants[0].option.color", "Red", "json_ld", 0.95, ""), ("variants[0].option.size", "M", "json_ld", 0.95, ""), ("variants[0].sku", "a1", "json_ld", 0.95, ""), ("variants[0].gtin", "10012345678902", "json_ld", 0.95, ""),
            ("variants[0].barcode", "10012345678902", "json_ld", 0.95, ""), ("variants[0].price", "12", "json_ld", 0.95, ""), ("variants[1].option.color", "Blue", "json_ld", 0.95, ""), ("variants[1].sku", "a2", "json_ld", 0.95, ""),
        ],
    ),
    (
        """<div><meta itemprop="name" content="Mug &amp; lid"><span itemprop="price" content="7.25">7</span><span itemprop="sku">M-1</span></div><div typeof="Product"><span property="name">Mug &#8211; white</span><meta property="schema:brand" content="Clay"></div>""",
        [("title", "Mug & lid", "microdata", 0.8, "Mug – white"), ("base_price", "7.25", "microdata", 0.8, ""), ("mpn", "M-1", "microdata", 0.8, ""), ("brand", "Clay", "rdfa", 0.8, "")],
    ),
    (
        """<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"list":[{"name":"Kurta","sellingPrice":"499","mrp":999,"brand":{"name":"Weave"},"breadCrumb":[{"name":"Women"},{"name":"Ethnic Wear"}],"sizes":[{"name":"S","product_variant_id":11,"qty_avail":2}]}]}}}</script>""",
        [
            ("title", "Kurta", "next_data", 0.85, ""), ("base_price", "499", "next_data", 0.85, ""), ("mrp", "999", "next_data", 0.85, ""), ("brand", "Weave", "next_data", 0.85, ""), ("productType", "women/ethnic_wear", "next_data", 0.85, ""),
            ("variants[0].option.size", "S", "next_data", 0.85, ""), ("variants[0].sku", "11", "next_data", 0.85, ""), ("variants[0].inventory_quantity", "2", "next_data", 0.85, ""),
        ],
    ),
    (
        """<script>window.__NUXT__={"payload":{"product":{"name":"Lamp","price":"30","attributes":{"watt":9}}}}</script><script>window.__INITIAL_STATE__={"product":{"title":"Lamp 9W","vendor":"Lux"}}</script>""",
        [("title", "Lamp", "nuxt", 0.85, "Lamp 9W"), ("base_price", "30", "nuxt", 0.85, ""), ("watt", "9", "nuxt", 0.85, ""), ("brand", "Lux", "initial_state", 0.8, "")],
    ),
    ("<p>captcha</p>", []),
]
#: Pages of known sites: address, markup, facts (raw key, value, confidence).
SITE_PAGES = [
    (
        "https://www.amazon.in/Tent-2/dp/B0ABCDEFGH?th=1",
        """<span id="productTitle"> Dome Tent </span><a id="bylineInfo">Visit the Acme Store</a><span class="a-price"><span class="a-offscreen">₹1,299.00</span></span>
        <div id="feature-bullets"><ul><li><span>For two people</span></li><li><span>Dry</span></li></ul></div><div id="altImages"><ul><li><img src="https://i/1.jpg"></li></ul></div>
        <table id="productDetails_techSpec_section_1"><tr><th>Item Weight</th><td> 2 kg </td></tr></table>""",
        [("asin", "B0ABCDEFGH", 1.0), ("title", "Dome Tent", 0.95), ("brand", "Acme", 0.85), ("base_price", "1299", 0.92), ("currency", "INR", 0.85), ("description", "For two people", 0.8), ("images", '["https://i/1.jpg"]', 0.85), ("item_weight", "2 kg", 0.75)],
    ),
    (
        "https://www.ebay.co.uk/itm/camera/123456789",
        """<h1 class="x-item-title__mainTitle"><span>Film camera</span></h1><div class="x-price-primary"><span class="ux-textspans">£45.50</span></div>
        <div class="ux-labels-values"><div class="ux-labels-values__labels-content">Film Format</div><div class="ux-labels-values__values-content">35 mm</div></div><div class="ux-image-carousel-item"><img src="https://i/c.jpg"></div>""",
        [("item_id", "123456789", 1.0), ("title", "Film camera", 0.95), ("base_price", "45.5", 0.9), ("currency", "GBP", 0.85), ("film_format", "35 mm", 0.8), ("images", '["https://i/c.jpg"]', 0.8)],
    ),
    (
        "https://www.walmart.com/ip/tv/55501",
        """<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"initialData":{"data":{"product":{"name":"TV 55","brand":"Vista","price":{"price":299.99,"currencyUnit":"USD"},"gtin":"0123456789012"}}}}}}</script>
        <h1 itemprop="name">other</h1><div data-testid="product-specifications"><table><tr><td>Screen Size</td><td>55 in</td></tr><tr><td>HDR</td><td>hdr</td></tr></table></div>""",
        [("product_id", "55501", 1.0), ("title", "TV 55", 0.95), ("brand", "Vista", 0.9), ("base_price", "299.99", 0.93), ("currency", "USD", 0.93), ("gtin", "0123456789012", 0.95), ("screen_size", "55 in", 0.75)],
    ),
    (
        "https://www.croma.com/phone-x/p/270001",
        """<script type="application/ld+json">{"@type":"Product","name":"Phone X","gtin":890,"gtin13":8901234567890,"offers":{"priceSpecification":{"price":"19999","priceCurrency":"INR"}}}</script><div class="brand-name">Fone</div>
        <ul class="pdp-specifications-list"><li class="specification-item"><b class="spec-label">RAM (GB)</b><i class="spec-value">8</i></li></ul>""",
        [("sku", "270001", 1.0), ("title", "Phone X", 0.95), ("gtin", "8901234567890", 0.95), ("base_price", "19999", 0.93), ("currency", "INR", 0.93), ("brand", "Fone", 0.85), ("ram_gb", "8", 0.75)],
    ),
    (
        "https://www.bestbuy.com/site/laptop/6501.p?skuId=6501",
        """<h1 class="heading-5 v-fw-regular">Laptop 14</h1><div class="priceView-customer-price"><span aria-hidden="true">$1,049.99</span></div><div class="model-number"><span class="product-data-value">LP-14</span></div>
        <table class="specs-table"><tbody><tr><td class="row-title">Storage</td><td class="row-value">512 GB</td></tr></tbody></table>""",
        [("sku", "6501", 1.0), ("title", "Laptop 14", 0.92), ("base_price", "1049.99", 0.9), ("currency", "USD", 0.85), ("model_number", "LP-14", 0.88), ("storage", "512 GB", 0.75)],
    ),
    ("https://shop.amazon.example/dp/B0ABCDEFGH", "<span id='productTitle'>x</span>", []),
    ("https://smile.amazon.de/dp/B012345678", "", [("asin", "B012345678", 1.0)]),
]
#: Marketplace records: JSON, facts (raw key, value, confidence, method), inventory (location, available).
RECORDS = [
    (
        '{"id":"r0","updated_at":"2026-01-02T03:04:05Z","_nango_metadata":{"x":1},"title":" Tee ","vendor":"Acme","status":"ACTIVE","tags":["a","b"],"variants":[{"id":"1","sku":"t-1","barcode":"","price":"12.50","inventoryQuantity":3,"selectedOptions":[{"name":"Size","value":"M"}]},{"id":"2","sku":" t-2 ","barcode":"4006381333931","price":"9","selectedOptions":[]}]}',
        [
            ("title", "Tee", 1.0, "direct"), ("vendor", "Acme", 0.95, "direct"), ("status", "active", 1.0, "direct"), ("tags", '["a","b"]', 0.9, "direct"), ("base_price", "9", 0.95, "computed"), ("gtin", "4006381333931", 0.9, "direct"), ("model_number", "t-1", 0.7, "inferred"),
            ("variants[0].sku", "t-1", 0.95, "direct"), ("variants[0].price", "12.5", 0.95, "direct"), ("variants[0].option.Size", "M", 0.95, "direct"), ("variants[1].sku", "t-2", 0.95, "direct"), ("variants[1].barcode", "4006381333931", 0.9, "direct"), ("variants[1].price", "9", 0.95, "direct"),
        ],
        [("1", 3), ("2", 0)],
    ),
    ('{"id":"r1","updated_at":"never","title":"Bowl","productType":"Kitchen","images":[{"url":"http://i/b.jpg"}],"variants":[]}', [("title", "Bowl", 1.0, "direct"), ("productType", "Kitchen", 0.85, "direct"), ("images", '[{"url":"http://i/b.jpg"}]', 1.0, "direct")], []),
    ('{"title":"no id"}', [], []),
    ("{broken", [], []),
]
#: What a shop gives beside a page: address, JSON, facts of the probe, facts of the page's own JSON.
SHOP_JSON = [
    (
        "https://s.example/products/mug?variant=22",
        '{"product":{"title":"Mug","vendor":"Clay","body_html":"<p>x</p>","product_type":"Cups","variants":[{"id":21,"sku":"m1","price":"5.00","title":"White","inventory_quantity":4},{"id":22,"sku":"m2","price":"6.50","barcode":"40063813","option1":"Blue"}]}}',
        [
            ("title", "Mug"), ("vendor", "Clay"), ("description", "<p>x</p>"), ("productType", "Cups"), ("variants[0].sku", "m1"), ("variants[0].price", "5.00"), ("variants[0].inventory_quantity", "4"), ("variants[0].option.option1", "White"),
            ("variants[1].sku", "m2"), ("variants[1].barcode", "40063813"), ("variants[1].price", "6.50"), ("variants[1].option.option1", "Blue"),
        ],
        [("title", "Mug"), ("brand", "Clay"), ("description", "<p>x</p>"), ("category_path", "Cups"), ("base_price", "6.5"), ("gtin", "40063813")],
    ),
    ("https://s.example/pages/about", '{"product":{"title":"No"}}', [("title", "No")], []),
    ("https://s.example/products/mug/", '{"title":"Flat","variants":[{"id":1,"price":"3"}]}', [("title", "Flat"), ("variants[0].price", "3")], []),
]
#: A text model's answers, and the facts (raw key, value, confidence) of each.
ANSWERS = [
    (
        '{"title":"Kettle","gtin":" 40063813 ","base_price":24.9,"currency":"eur","category_path":"home/kitchen","images":[{"url":"http://i/k.jpg"},{"url":"ftp://no"}],"attributes":{"volume":"1.7 l","colour":""},"variants":[{"sku":" k1 ","price":24,"option_values":{"color":"red"}}],"_field_confidence":{"title":0.99,"base_price":0.4,"variants":0.6}}',
        [
            ("title", "Kettle", 0.85), ("gtin", "40063813", 0.5), ("base_price", "24.9", 0.4), ("currency", "EUR", 0.5), ("productType", "home/kitchen", 0.5), ("images", '["http://i/k.jpg"]', 0.5), ("volume", "1.7 l", 0.5),
            ("variants[0].sku", "k1", 0.6), ("variants[0].price", "24", 0.6), ("variants[0].option.color", "red", 0.6),
        ],
    ),
    ('{"error":"no product","title":null}', []),
    ('{"title":"Pan","currency":"EURO"}', []),
    ('{"title":"Pot","base_price":"12"}', []),
    ("not json", []),
    ('{"title":"Pot","brand":"Steel","error":"odd page"}', [("title", "Pot", 0.5), ("brand", "Steel", 0.5)]),
]
