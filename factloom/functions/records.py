"""Product records of marketplaces, and the JSON that shops give for a page: facts by SQL functions on variants."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from factloom.functions.html import script_by_id
from factloom.functions.scalars import let, strip_key

# Fields of a record with raw key, method and confidence; paths and members of a page's application state.
RECORD_TEXTS = [("title", "title", "direct", 1.0), ("vendor", "vendor", "direct", 0.95), ("productType", "productType", "direct", 0.85), ("status", "status", "direct", 1.0)]
RECORD_LISTS = [("tags", "direct", 0.90), ("images", "direct", 1.0)]
VARIANT_FIELDS = [("sku", 0.95), ("barcode", 0.90), ("price", 0.95)]
SHOP_PATHS = [["props", "pageProps", "product"], ["props", "pageProps", "shop", "product"], ["props", "initialState", "product"], ["props", "pageProps", "data", "product"]]
PRODUCT_KEYS = """name title productName displayName price sellingPrice listPrice salePrice mrp amount priceValue discountedPrice sku skus gtin
barcode brand vendor manufacturer sizes variants options colors description shortDescription images media photos breadCrumb breadcrumb
breadcrumbs category categoryPath color material""".split()
NAMES, PRICES = ["name", "title", "productName", "displayName"], ["price", "sellingPrice", "listPrice", "salePrice", "mrp", "amount", "priceValue", "discountedPrice"]
FIRST_PRICES = ["price", "sellingPrice", "salePrice", "discountedPrice", "amount", "priceValue"]
NEXT_CONFIDENCE, PROBE_CONFIDENCE = 0.85, 0.95

_VARIANT = "array<struct<id:string,sku:string,barcode:string,price:string,title:string,option1:string,inventory_quantity:string,inventoryQuantity:string,selectedOptions:array<struct<name:string,value:string>>>>"
_FACT = "array<struct<raw_key:string,value:string,confidence:double,method:string>>"


def get(j: Column, path: str) -> Column:
    return F.get_json_object(j, path)


def full(text: Column) -> Column:
    """A text that isn't blank, trimmed."""
    return F.nullif(F.trim(text), F.lit(""))


def fact(key: str | Column, value: Column, confidence: float, method: str = "direct") -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("raw_key"), value.cast("string").alias("value"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def facts_with_values(*lists: Column) -> Column:
    return F.filter(F.concat(*[F.coalesce(x.cast(_FACT), F.array().cast(_FACT)) for x in lists]), lambda f: f["value"].isNotNull())


def variants_of(j: Column, path: str = "$.variants") -> Column:
    return F.from_json(get(j, path), _VARIANT)


def number(text: Column) -> Column:
    return text.try_cast("double")


def plain(n: Column) -> Column:
    """A number as text, without a fraction where it is whole."""
    return F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))


def record_facts(records: DataFrame, key: str = "external_id", raw: str = "raw") -> DataFrame:
    """key, raw_key, value, confidence, method of marketplace records (key, raw: JSON text).

    Texts trimmed; base_price the least variant price, gtin the first barcode, model_number the first SKU
    (inferred); then each variant's facts. Lists are JSON text. Broken JSON gives nothing.
    """
    j = F.col(raw)
    texts = F.array(*[fact(k, F.lower(full(get(j, f"$.{f}"))) if k == "status" else full(get(j, f"$.{f}")), c, m) for f, k, m, c in RECORD_TEXTS])
    listed = lambda f: F.when(F.json_array_length(get(j, f"$.{f}")) > 0, get(j, f"$.{f}"))
    lists = F.array(*[fact(f, listed(f), c, m) for f, m, c in RECORD_LISTS], fact("options", listed("options"), 1.0))

    def of(v: Column) -> Column:
        first = lambda name: F.get(F.filter(F.transform(v, lambda x: full(x[name])), lambda x: x.isNotNull()), F.lit(0))
        least = F.array_min(F.filter(F.transform(v, lambda x: number(x["price"])), lambda x: x.isNotNull()))
        top = F.array(fact("base_price", plain(least), 0.95, "computed"), fact("gtin", first("barcode"), 0.90), fact("model_number", first("sku"), 0.70, "inferred"))

        def each(x: Column, i: Column) -> Column:
            at = F.concat(F.lit("variants["), i.cast("string"), F.lit("]."))
            own = F.array(*[fact(F.concat(at, F.lit(n)), plain(number(x[n])) if n == "price" else full(x[n]), c) for n, c in VARIANT_FIELDS])
            options = F.transform(F.coalesce(x["selectedOptions"], F.array()), lambda o: fact(F.concat(at, F.lit("option."), o["name"]), o["value"], 0.95))
            return F.concat(own.cast(_FACT), options.cast(_FACT))

        return F.concat(top.cast(_FACT), F.flatten(F.transform(v, each)))

    rows = records.select(F.col(key), F.posexplode(facts_with_values(texts, lists, let(variants_of(j), of))).alias("ordinal", "f"))
    return rows.select(key, "f.*", "ordinal")


def normal_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """external_id, modified_at, raw of records (raw: JSON text) that have an id: without the sync's own metadata.

    A time that is none is null. Records without an id, and those that aren't JSON, go to missing_id (see there).
    """
    stripped = raw.withColumn(column, strip_key("_nango_metadata")(F.col(column)))
    return stripped.select(F.nullif(get(F.col(column), "$.id"), F.lit("")).alias("external_id"), F.try_to_timestamp(get(F.col(column), "$.updated_at")).alias("modified_at"), column).filter("external_id is not null")


def missing_id(raw: DataFrame, column: str = "raw") -> DataFrame:
    return raw.filter(F.coalesce(get(F.col(column), "$.id"), F.lit("")) == "")


def inventory(records: DataFrame, key: str = "external_id", raw: str = "raw") -> DataFrame:
    """key, location, available: the variants of records; an unknown quantity is 0, a record without variants gives none."""
    v = records.select(key, F.explode(variants_of(F.col(raw))).alias("v"))
    return v.select(key, F.col("v.id").alias("location"), F.coalesce(F.col("v.inventoryQuantity").try_cast("long"), F.lit(0)).alias("available"))


def probe_facts(json_: Column) -> Column:
    """Facts of a product's JSON as a shop gives it beside a page: the product's own and each variant's."""
    j = F.coalesce(get(json_, "$.product"), json_)
    top = F.array(*[fact(k, get(j, f"$.{f}"), PROBE_CONFIDENCE) for k, f in (("title", "title"), ("vendor", "vendor"), ("description", "body_html"), ("productType", "product_type"))])

    def each(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("variants["), i.cast("string"), F.lit("]."))
        own = [fact(F.concat(at, F.lit(n)), x[n], PROBE_CONFIDENCE) for n in ("sku", "barcode", "price", "inventory_quantity")]
        return F.array(*own, fact(F.concat(at, F.lit("option.option1")), F.coalesce(x["option1"], x["title"]), PROBE_CONFIDENCE)).cast(_FACT)

    return facts_with_values(top, let(variants_of(j), lambda v: F.flatten(F.transform(v, each))))


def products_json_facts(url: Column, json_: Column) -> Column:
    """Facts of a product page's own JSON: price and gtin are those of the variant that the url names, or of the first.

    Only for urls of the form /products/<handle>.
    """
    j = get(json_, "$.product")
    on = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+(/[^?#]*)", 1).rlike(r"^/products/[^/]+/?$")
    asked = F.nullif(F.regexp_extract(url, r"[?&]variant=([^&#]*)", 1), F.lit(""))
    v = variants_of(j)
    chosen = F.coalesce(F.get(F.filter(v, lambda x: x["id"] == asked), F.lit(0)), F.get(v, F.lit(0)))
    texts = [fact(k, F.when(full(get(j, f"$.{f}")).isNotNull(), get(j, f"$.{f}")), PROBE_CONFIDENCE) for k, f in (("title", "title"), ("brand", "vendor"), ("description", "body_html"), ("category_path", "product_type"))]
    picked = let(chosen, lambda x: F.array(fact("base_price", plain(number(x["price"])), PROBE_CONFIDENCE), fact("gtin", full(x["barcode"]), PROBE_CONFIDENCE)).cast(_FACT))
    return F.when(on, facts_with_values(F.array(*texts), picked))


def _text(v: object) -> str | None:
    return v if isinstance(v, str) and v.strip() else None


def _number(v: object) -> str | None:
    if isinstance(v, str):
        try:
            v = float(v) if v.strip() else 0.0
        except ValueError:
            return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != v or v in (float("inf"), float("-inf")):
        return None
    return f"{v:.15g}"


def _hydrogen(product: object) -> list[dict] | None:
    """Variants of a product as the shop's own front end has it, else null."""
    if not isinstance(product, dict):
        return None
    v = product.get("variants")
    if isinstance(v, dict) and isinstance(v.get("nodes"), list):
        return [x for x in v["nodes"] if isinstance(x, dict)]
    if isinstance(v, list) and v and isinstance(v[0], dict) and (isinstance(v[0].get("selectedOptions"), list) or isinstance(v[0].get("price"), dict)):
        return [x for x in v if isinstance(x, dict)]
    return None


def _hydrogen_facts(product: dict, variants: list[dict]) -> Iterator[tuple[str, str | None]]:
    yield from (("title", _text(product.get("title"))), ("brand", _text(product.get("vendor"))), ("description", _text(product.get("description"))))
    currency = None
    for i, v in enumerate(variants):
        at, price = f"variants[{i}].", v.get("price")
        sku = v.get("sku")
        yield at + "sku", _text(sku) or (_number(sku) if not isinstance(sku, str) else None)
        for o in v.get("selectedOptions") or []:
            if isinstance(o, dict) and _text(o.get("name")) and _text(o.get("value")):
                yield f"{at}option.{o['name'].lower()}", o["value"]
        yield at + "price", _number(price.get("amount") if isinstance(price, dict) else price if not isinstance(price, str) else None)
        if isinstance(price, dict):
            currency = currency or _text(price.get("currencyCode"))
        yield at + "inventory_quantity", _number(v.get("quantityAvailable")) if not isinstance(v.get("quantityAvailable"), str) else None
    yield "currency", currency


def _most_like_a_product(root: object, depth: int = 8) -> dict | None:
    """Of nested objects with a name and a price, the first that has most of a product's keys, three at least."""
    best, most, left = None, 2, [(root, 0)]
    while left:
        v, d = left.pop()
        if d > depth or not isinstance(v, dict):
            continue
        score = sum(k in v for k in PRODUCT_KEYS)
        if score > most and any(isinstance(v.get(k), str) for k in NAMES) and any(v.get(k) not in (None, "") and _number(v[k]) is not None for k in PRICES):
            best, most = v, score
        inner = [x for w in v.values() for x in (w if isinstance(w, list) else [w]) if isinstance(x, dict)]
        left += [(x, d + 1) for x in reversed(inner)]
    return best


def _generic_facts(p: dict) -> Iterator[tuple[str, str | None]]:
    first = lambda keys: next((p[k] for k in keys if p.get(k) is not None), None)
    yield from (("title", _text(first(NAMES))), ("base_price", _number(first(FIRST_PRICES))), ("mrp", _number(first(["mrp", "listPrice"]))), ("description", _text(p.get("description"))))
    color, brand = p.get("color"), first(["brand", "vendor", "manufacturer"])
    yield "color", _text(color.get("name") if isinstance(color, dict) else color)
    yield "brand", _text(brand.get("name") if isinstance(brand, dict) else brand)
    crumbs = next((p[k] for k in ("breadCrumb", "breadcrumb", "breadcrumbs") if isinstance(p.get(k), list)), [])
    names = [c["name"] for c in crumbs if isinstance(c, dict) and isinstance(c.get("name"), str)]
    yield "productType", "/".join("_".join(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split()) for n in names) or None
    images = p.get("images")
    urls = [x["url"] for k in ("original", "display", "additional") for x in (images.get(k) or []) if isinstance(x, dict) and isinstance(x.get("url"), str)] if isinstance(images, dict) else []
    yield "images", json.dumps(urls) if urls else None
    variants = next((p[k] for k in ("sizes", "skus", "variants") if isinstance(p.get(k), list)), [])
    for i, v in enumerate(x for x in variants if isinstance(x, dict)):
        at = f"variants[{i}]."
        yield from ((at + "option.size", _text(v.get(k))) for k in ("name", "optionLabel"))
        sku = v.get("product_variant_id") or v.get("sku") or v.get("id")
        yield at + "sku", None if sku is None else str(sku)
        stock = v["qty_avail"] if v.get("qty_avail") is not None else v.get("inventoryQuantity")
        yield at + "inventory_quantity", _number(stock)


def next_facts_of(text: str | None) -> list[tuple[str, str]]:
    """(raw key, value) of the product in a page's application state."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return []
    for path in SHOP_PATHS:
        v = root
        for name in path:
            v = v.get(name) if isinstance(v, dict) else None
        if (variants := _hydrogen(v)) is not None:
            return [(k, x) for k, x in _hydrogen_facts(v, variants) if x is not None]
    product = _most_like_a_product(root)
    return [(k, x) for k, x in _generic_facts(product) if x is not None] if product else []


@F.pandas_udf(ArrayType(StructType([StructField("raw_key", StringType()), StructField("value", StringType())])))
def _next_product(json_: pd.Series) -> pd.Series:
    return json_.map(lambda text: None if text is None else [{"raw_key": k, "value": v} for k, v in next_facts_of(text)])


def next_array(html: Column) -> Column:
    """FOUND of the application state that a page holds as JSON, which nests to any depth; other pages send a null."""
    found = _next_product(F.when(html.contains("__NEXT_DATA__"), script_by_id(html, "__NEXT_DATA__")))
    return F.transform(found, lambda f, i: F.struct(f["raw_key"].alias("raw_key"), f["value"].alias("value"), F.lit(NEXT_CONFIDENCE).alias("confidence"), F.lit("next_data").alias("parser"), (i + 10_000).alias("ordinal")))


def next_facts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, raw_key, value, confidence, parser, ordinal of the application state of pages (page, html)."""
    return pages.select(F.col(page).alias("page"), F.explode(next_array(F.col("html"))).alias("f")).select("page", "f.*")


#: Marketplace -> its records' facts.
EXTRACTORS = {"shopify": record_facts}


def extract_records(records: DataFrame) -> DataFrame:
    """record_facts of each marketplace of records (marketplace, external_id, raw); an unknown marketplace is an error."""
    unknown = [r[0] for r in records.select("marketplace").distinct().limit(len(EXTRACTORS) + 1).collect() if r[0] not in EXTRACTORS]
    if unknown:
        raise ValueError(f"no extractor for {unknown}")
    out = None
    for name, extractor in EXTRACTORS.items():
        part = extractor(records.filter(F.col("marketplace") == name)).withColumn("marketplace", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
