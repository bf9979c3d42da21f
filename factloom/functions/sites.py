"""Facts from the product pages of known sites, by rules: where in a page a field stands, and how sure it is."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.html import MAX_BYTES
from factloom.functions.scalars import host_of
from factloom.functions.tree import Element, read

# Currency signs; domains, item paths and places of fields of each site.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY"}
DOMAINS = {
    "amazon": ["amazon.com", "amazon.co.uk", "amazon.de", "amazon.fr", "amazon.in", "amazon.co.jp", "amazon.ca", "amazon.com.au"],
    "ebay": ["ebay.com", "ebay.co.uk", "ebay.de", "ebay.com.au", "ebay.fr", "ebay.it"],
    "walmart": ["walmart.com"],
    "croma": ["croma.com"],
    "bestbuy": ["bestbuy.com", "bestbuy.ca"],
}
ITEM = {
    "amazon": ("asin", r"/dp/([A-Z0-9]{10})"),
    "ebay": ("item_id", r"/itm/(?:[^/]+/)?(\d{6,})"),
    "walmart": ("product_id", r"/ip/[^/]+/(\d+)"),
    "croma": ("sku", r"(?i)/p/([a-z0-9-]+)"),
    "bestbuy": ("sku", r"/site/[^/]+/(\d+)\.p"),
}
#: Members of the product in a page's JSON, with their confidence; they go before what the markup shows.
WALMART_PATH = ["props", "pageProps", "initialData", "data", "product"]
WALMART = {"title": (["name"], 0.95), "brand": (["brand"], 0.90), "base_price": (["price", "price"], 0.93), "currency": (["price", "currencyUnit"], 0.93), "gtin": (["gtin"], 0.95), "model_number": (["model"], 0.90)}
CROMA_GTIN = ["gtin13", "gtin", "gtin8", "gtin12", "gtin14"]
#: (raw key, how, selector, confidence): the text of all or of the first, a price and its sign's currency, lists.
FIELDS = {
    "amazon": [
        ("title", "all", "#productTitle", 0.95), ("brand", "byline", "#bylineInfo", 0.85), ("base_price", "price", ".a-price .a-offscreen", 0.92),
        ("description", "bullets", "#feature-bullets li span", 0.80), ("images", "images", "#altImages li img", 0.85),
    ],
    "ebay": [
        ("title", "all", "h1.x-item-title__mainTitle", 0.95), ("base_price", "price", ".x-price-primary span[itemprop='price'] | .x-price-primary .ux-textspans", 0.90),
        ("images", "images", ".ux-image-carousel-item img", 0.80),
    ],
    "walmart": [("title", "all", "h1[itemprop='name']", 0.85), ("base_price", "price", "[data-automation-id='product-price']", 0.80)],
    "croma": [
        ("title", "first", "h1.pd-title, h1.product-title", 0.88), ("brand", "first", ".brand-name", 0.85), ("base_price", "price", ".new-price, .product-price .amount, .product-price", 0.82),
        ("images", "images", ".product-image img, .image-gallery img", 0.80),
    ],
    "bestbuy": [
        ("title", "first", "h1.heading-5, .heading-5.v-fw-regular", 0.92), ("base_price", "price", ".priceView-customer-price span[aria-hidden='true']", 0.90),
        ("model_number", "first", ".model-number .product-data-value", 0.88), ("images", "images", ".primary-image-wrapper img, .thumbnail-list img", 0.80),
    ],
}
#: (row, key, value, confidence, which of several keys and values): tables of specifications.
SPECS = {
    "amazon": ("#productDetails_techSpec_section_1 tr, #productDetails_detailBullets_sections1 tr", "th, .a-text-bold", "td, .a-list-item span:last-child", 0.75, "all", "all"),
    "ebay": (".ux-labels-values", ".ux-labels-values__labels-content", ".ux-labels-values__values-content", 0.80, "all", "all"),
    "walmart": ("[data-testid='product-specifications'] table tr", "td", "td", 0.75, "first", "last"),
    "croma": (".pdp-specifications-list .specification-item", ".spec-label", ".spec-value", 0.75, "all", "all"),
    "bestbuy": (".specs-table tbody tr", ".row-title, th", ".row-value, td", 0.75, "first", "last"),
}
SIGN_CONFIDENCE = {"amazon": 0.85, "ebay": 0.85, "walmart": 0.75, "croma": 0.80, "bestbuy": 0.85}

Fact = tuple[str, str, float]


def site_of(pages: DataFrame, page: str = "page_id", domains: dict[str, list[str]] | None = None) -> DataFrame:
    """page and site of the pages whose host is one of a site's domains, or ends in one: the sites before others win.

    A host's suffixes are few, so they are joined by equality: the table of domains may grow.
    """
    spark = pages.sparkSession
    known = spark.createDataFrame([(d, s, i) for i, (s, all_) in enumerate((domains or DOMAINS).items()) for d in all_], "suffix string, site string, rank int")
    parts = F.split(F.regexp_replace(host_of(F.col("url")), r"^www\.", ""), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    rows = pages.select(F.col(page).alias("page"), F.explode(suffixes).alias("suffix")).join(known, "suffix")
    return rows.groupBy("page").agg(F.min_by("site", "rank").alias("site"))


def slug(text: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", text.lower()))


def joined(found: list[Element], which: str) -> str:
    if which == "all":
        return "".join(e.text() for e in found).strip()
    return found[0 if which == "first" else -1].text() if found else ""


def priced(text: str) -> tuple[str | None, str | None]:
    """The number in a shown price, and the currency of its sign."""
    digits = re.match(r"\d*\.?\d+|\d+", re.sub(r"[^\d.]", "", text))
    sign = next((c for c in text if c in SIGNS), None)
    return (None if digits is None else f"{float(digits[0]):.15g}"), SIGNS.get(sign)


def shown(root: Element, site: str, had: set[str]) -> Iterator[Fact]:
    for key, how, selector, confidence in FIELDS[site]:
        if key in had:
            continue
        found = next((f for way in selector.split("|") if (f := root.select(way)) and (how != "price" or joined(f, "first"))), [])
        if how == "price":
            number, currency = priced(joined(found, "first"))
            if number is not None:
                yield key, number, confidence
            if currency and "currency" not in had:
                yield "currency", currency, SIGN_CONFIDENCE[site]
            continue
        if how == "images":
            urls = [e.attrs["src"] for e in found if e.attrs.get("src")]
            value = json.dumps(urls) if urls else ""
        elif how == "bullets":
            value = "\n".join(t for e in found if len(t := e.text()) > 5)
        else:
            value = joined(found, "first" if how == "first" else "all")
        if how == "byline":
            value = re.sub(r"(?i)\s+Store$", "", re.sub(r"(?i)^Visit the\s+", "", value)).strip()
        if value:
            yield key, value, confidence
    row, key, value, confidence, which_key, which_value = SPECS[site]
    for e in root.select(row):
        k, v = slug(joined(e.select(key), which_key)), joined(e.select(value), which_value)
        if k and v and not (site == "walmart" and k == slug(v)):
            yield k, v, confidence


def member(v: object, path: list[str]) -> object:
    for name in path:
        v = v.get(name) if isinstance(v, dict) else None
    return v


def written_out(site: str, root: Element) -> Iterator[Fact]:
    """Facts of the product that a page's scripts hold as JSON."""
    if site == "walmart":
        script = next(iter(root.select("script#__NEXT_DATA__")), None)
        product = member(loads("".join(x for x in script.inside if isinstance(x, str))) if script else None, WALMART_PATH)
        for key, (path, confidence) in WALMART.items():
            v = member(product, path)
            if key == "brand" and isinstance(v, dict):
                v = v.get("name")
            wanted = (int, float) if key == "base_price" else str
            if isinstance(v, wanted) and not isinstance(v, bool) and v != "":
                yield key, f"{v:.15g}" if key == "base_price" else v, confidence
    if site == "croma":
        blocks = (loads("".join(x for x in s.inside if isinstance(x, str))) for s in root.select("script[type='application/ld+json']"))
        each = (c for b in blocks for c in (b if isinstance(b, list) else [b]))
        product = next((c for c in each if isinstance(c, dict) and c.get("@type") == "Product"), {})
        if isinstance(product.get("name"), str):
            yield "title", product["name"], 0.95
        brand = member(product, ["brand", "name"]) or product.get("brand")
        if isinstance(brand, str) and brand:
            yield "brand", brand, 0.90
        if gtin := next((product[k] for k in CROMA_GTIN if product.get(k) is not None), None):
            yield "gtin", str(gtin), 0.95
        offers = product.get("offers")
        price = next((p for p in (member(offers, ["price"]), member(offers, ["priceSpecification", "price"])) if p is not None), None)
        if price is not None and (number := re.match(r"\s*-?\d*\.?\d+", str(price))):
            yield "base_price", f"{float(number[0]):.15g}", 0.93
        if currency := member(offers, ["priceCurrency"]) or member(offers, ["priceSpecification", "priceCurrency"]):
            yield "currency", str(currency), 0.93


def loads(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def facts_of(site: str, url: str, html: str | None) -> list[Fact]:
    """(raw key, value, confidence) of a page of a site; the item's id comes from the url, whatever the page holds."""
    key, pattern = ITEM[site]
    item = re.search(pattern, url or "")
    root = read(html)
    out = [(key, item[1], 1.0)] if item else []
    out += written_out(site, root)
    return out + list(shown(root, site, {k for k, _, _ in out}))


#: Pages whose facts are held at once in a task.
PAGES = 32


def site_facts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, raw_key, value, confidence, parser, ordinal of the pages of known sites; others are not read.

    pages: page, url, html. A null page, and one over 4 MB, gives what its url tells. Images are a JSON list of their addresses.
    """
    read_html = F.when(F.octet_length("html") <= MAX_BYTES, F.col("html")).alias("html")
    rows = pages.select(F.col(page).alias("page"), "url", read_html).join(site_of(pages, page), "page").select("page", "site", "url", "html")
    kind = rows.schema["page"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, PAGES) for whole in batches for lo in range(0, whole.num_rows, PAGES)):
            at, facts = [], []
            for i, (site, url, html) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for n, (key, value, confidence) in enumerate(facts_of(site, url, html)):
                    at.append(i)
                    facts.append((key, value, confidence, f"per_site_parser:{site}", n))
            cols = [b.column(0).take(pa.array(at, pa.int64()))]
            cols += [pa.array([f[k] for f in facts], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["page", "raw_key", "value", "confidence", "parser", "ordinal"])

    return rows.mapInArrow(run, f"page {kind}, raw_key string, value string, confidence double, parser string, ordinal int")
