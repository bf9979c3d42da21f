"""Facts from what shop platforms write into a page's scripts, classes and properties, in SQL functions: one scan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.elements import text_of, with_elements
from factloom.functions.html import FOUND, attribute, decode, has_class, readable, script_blocks, script_by_id, window_assignment
from factloom.functions.scalars import let, lookup

# Where a product stands in a page's state, and the members that give a raw key, best first.
NUXT_PATHS = ["payload.product", "payload.state.product", "payload.data.product", "payload.pageProps.product"]
STATE_PATHS = ["product", "state.product", "data.product", "pageProps.product", *NUXT_PATHS]
STATE_TEXTS = {"title": ["name", "title"], "brand": ["brand", "vendor"], "gtin": ["gtin", "barcode"], "model_number": ["mpn", "model"], "description": ["description"]}
STATE_PRICE = ["price", "sellingPrice"]
HIT_TEXTS = {"title": ["name", "title"], "brand": ["brand", "vendor"], "gtin": ["gtin"], "model_number": ["mpn", "sku"], "description": ["description"]}
VIEW_TEXTS = {"title": ["productName", "name", "title"], "brand": ["brand"], "model_number": ["sku", "mpn", "model"], "gtin": ["gtin"], "description": ["description"]}
VIEW_PRICE = ["price", "finalPrice"]
BOX_PRICES = ["priceConfig.prices.finalPrice.amount", "priceConfig.prices.regularPrice.amount", "priceConfig.productPrice.amount"]
RDFA_TYPES = ["Product", "schema:Product", "http://schema.org/Product"]
WOO = {"page": "single-product", "title": "product_title", "price": "woocommerce-Price-amount", "product": "product", "sku": "data-product_sku", "id": "data-product_id"}
VOID = ["meta", "link", "data"]
RDFA = {"name": "title", "brand": "brand", "gtin13": "gtin", "gtin14": "gtin", "gtin12": "gtin", "gtin8": "gtin", "gtin": "gtin", "price": "base_price", "description": "description"}
CONFIDENCE = {"nuxt": 0.85, "initial_state": 0.80, "magento": 0.80, "woocommerce": 0.75, "algolia": 0.75, "rdfa": 0.80}
#: First ordinal of a parser's facts: the order of arrival, which decides ties.
ORDINAL = {"nuxt": 30_000, "initial_state": 40_000, "magento": 50_000, "woocommerce": 60_000, "algolia": 70_000, "rdfa": 90_000}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_FACT = "array<struct<raw_key:string,value:string>>"


def _first(found: list[Column], test) -> Column:
    return F.get(F.filter(F.array(*found), test), F.lit(0))


def _member(v: Column, *paths: str) -> Column:
    """The first member of a variant that isn't null."""
    return _first([F.try_variant_get(v, f"$.{p}", "variant") for p in paths], lambda x: x.isNotNull() & ~F.is_variant_null(x))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _object(*found: Column) -> Column:
    """The first that is an object."""
    return _first(list(found), lambda x: _kind(x).startswith("OBJECT"))


def _text(v: Column) -> Column:
    def of(x: Column) -> Column:
        s = F.try_variant_get(x, "$", "string")
        return F.when((_kind(x) == "STRING") & (F.trim(s) != ""), s)

    return let(v, of)


def _number(v: Column) -> Column:
    """A number, or a text that is one (a blank text is none), as text."""

    def of(x: Column) -> Column:
        s = F.try_variant_get(x, "$", "string")
        return F.when((_kind(x) == "STRING") & s.rlike(_NUMBER), F.trim(s)).when(_kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), s)

    return let(v, of)


def _fact(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("raw_key"), value.alias("value"))


def _fields(v: Column, texts: dict[str, list[str]], price: list[str]) -> Column:
    """Facts of a product's members; those it lacks have a null value."""
    return let(v, lambda p: F.array(*[_fact(k, _text(_member(p, *names))) for k, names in texts.items()], _fact("base_price", _number(_member(p, *price)))).cast(_FACT))


def _state(json: Column, paths: list[str]) -> Column:
    """Facts of the first product object at one of the paths, and its scalar attributes."""

    def of(product: Column) -> Column:
        entries = F.map_entries(F.try_variant_get(_object(_member(product, "attributes")), "$", "map<string,variant>"))
        scalar = F.filter(entries, lambda e: ~_kind(e["value"]).rlike("^(OBJECT|ARRAY|VOID)"))
        attributes = F.transform(scalar, lambda e: F.struct(e["key"].alias("raw_key"), F.try_variant_get(e["value"], "$", "string").alias("value")))
        return F.concat(_fields(product, STATE_TEXTS, STATE_PRICE), F.coalesce(attributes.cast(_FACT), F.array().cast(_FACT)))

    product = let(F.try_parse_json(json), lambda root: _object(*[_member(root, p) for p in paths]))
    return let(product, of)


def _first_of_each(facts: Column) -> Column:
    """Facts with key and value, of each key the first."""
    found = F.filter(facts, lambda f: f["raw_key"].isNotNull() & f["value"].isNotNull())
    return F.aggregate(found, F.array().cast(_FACT), lambda had, f: F.when(F.exists(had, lambda g: g["raw_key"] == f["raw_key"]), had).otherwise(F.array_append(had, f)))


def nuxt(html: Column) -> Column:
    return _state(window_assignment(html, "__NUXT__"), NUXT_PATHS)


def initial_state(html: Column) -> Column:
    return _state(window_assignment(html, "__(?:INITIAL_STATE|PRELOADED_STATE)__"), STATE_PATHS)


def algolia(html: Column) -> Column:
    """The first hit only."""
    hit = _object(F.try_variant_get(F.try_parse_json(script_by_id(html, "__ALGOLIA_DATA__")), "$.hits[0]", "variant"))
    return _fields(hit, HIT_TEXTS, ["price"])


def magento(html: Column) -> Column:
    """Price boxes and product views of all init scripts, in their order; the first fact of a key counts."""

    def parts(json: Column) -> Column:
        return F.from_json(json, "map<string,string>")

    selectors = F.flatten(F.transform(script_blocks(html, "text/x-magento-init"), lambda b: F.coalesce(F.map_values(parts(b)), F.array().cast("array<string>"))))
    none = F.array().cast("array<struct<key:string,value:string>>")
    components = F.flatten(F.transform(selectors, lambda s: F.coalesce(F.map_entries(parts(s)), none)))

    def facts(e: Column) -> Column:
        is_box, is_view = e["key"].rlike("(?i)Magento_Catalog/js/price-box"), e["key"].rlike("(?i)Magento_Catalog/product/view")
        box = let(F.try_parse_json(e["value"]), lambda v: F.array(_fact("base_price", F.coalesce(*[_number(_member(v, p)) for p in BOX_PRICES]))).cast(_FACT))
        return F.when(is_box, box).when(is_view, _fields(F.try_parse_json(e["value"]), VIEW_TEXTS, VIEW_PRICE)).otherwise(F.array().cast(_FACT))

    return _first_of_each(F.flatten(F.transform(components, facts)))


def _shown(words: Column, e: Column) -> Column:
    return F.nullif(text_of(words, e), F.lit(""))


def rdfa(html: Column, all_: Column, words: Column) -> Column:
    """Properties from the first element of a product's type on: of void elements first, then of those with a text."""
    own = F.get(F.filter(all_, lambda e: attribute(e["attrs"], "typeof").isin(RDFA_TYPES)), F.lit(0))

    def facts(begin: Column) -> Column:
        some = F.filter(all_, lambda e: (e["pre"] >= begin["pre"]) & e["attrs"].contains("property"))
        named = F.filter(F.transform(some, lambda e: F.struct(e.alias("e"), F.regexp_replace(attribute(e["attrs"], "property"), "^schema:", "").alias("p"))), lambda x: x["p"].isNotNull())
        alone, others = F.filter(named, lambda x: x["e"]["name"].isin(VOID)), F.filter(named, lambda x: ~x["e"]["name"].isin(VOID))
        value = lambda e: F.coalesce(decode(attribute(e["attrs"], "content")), _shown(words, e))
        found = F.transform(F.concat(alone, others), lambda x: F.struct(lookup(RDFA, x["p"]).alias("raw_key"), value(x["e"]).alias("value")))
        return F.when(begin.isNotNull(), _first_of_each(found.cast(_FACT)))

    return F.filter(let(own, facts), lambda f: (f["raw_key"] != "base_price") | f["value"].rlike(_NUMBER))


def woocommerce(html: Column, all_: Column, words: Column) -> Column:
    """Title, price and identifiers of a page whose body has the class of single products; prices above 0."""
    first = lambda tag, name: F.get(F.filter(all_, lambda e: (e["name"] == tag) & has_class(e["attrs"], name)), F.lit(0))
    shown = let(first("span", WOO["price"]), lambda e: F.when(e.isNotNull(), _shown(words, e)))
    price = let(F.regexp_replace(shown, r"[^\d.]", ""), lambda x: F.when(x.try_cast("double") > 0, x))
    title = let(first("h1", WOO["title"]), lambda e: F.when(e.isNotNull(), _shown(words, e)))
    box = first("div", WOO["product"])["attrs"]
    facts = F.array(_fact("title", title), _fact("base_price", price), _fact("model_number", attribute(box, WOO["sku"])), _fact("sku", attribute(box, WOO["id"]))).cast(_FACT)
    return F.when(first("body", WOO["page"]).isNotNull(), facts)


#: Each parser, and what a page has where the parser could find anything: other pages cost one search.
PARSERS = {
    "nuxt": (nuxt, r"window\.__NUXT__"), "initial_state": (initial_state, r"window\.__(INITIAL|PRELOADED)_STATE__"), "magento": (magento, "(?i)text/x-magento-init"),
    "woocommerce": (woocommerce, "(?i)single-product"), "algolia": (algolia, "(?i)__ALGOLIA_DATA__"), "rdfa": (rdfa, "(?i)typeof="),
}
#: Parsers that read elements, and what pages have that need them.
OF_ELEMENTS = ["woocommerce", "rdfa"]
SWEPT = "(?i)" + "|".join(PARSERS[n][1].removeprefix("(?i)") for n in OF_ELEMENTS)


def inline_array(html: Column, elements: Column, words: Column) -> Column:
    """FOUND of all parsers here; elements and words as of with_elements, null for pages without SWEPT."""

    def of(name: str) -> Column:
        parser, mark = PARSERS[name]
        row = lambda f, i: F.struct(f["raw_key"].alias("raw_key"), f["value"].alias("value"), F.lit(CONFIDENCE[name]).alias("confidence"), F.lit(name).alias("parser"), (i + ORDINAL[name]).alias("ordinal"))
        found = parser(html, elements, words) if name in OF_ELEMENTS else parser(html)
        facts = F.transform(F.coalesce(F.when(html.rlike(mark), found.cast(_FACT)), F.array().cast(_FACT)), row)
        return F.filter(facts, lambda f: f["value"].isNotNull()).cast(FOUND)

    return F.concat(*[of(n) for n in PARSERS])


def inline_facts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, raw_key, value, confidence, parser, ordinal of all parsers here, for captcha-free pages.

    Broken JSON, a null page and a page of no such platform give nothing.
    """
    swept = with_elements(readable(pages).select(F.col(page).alias("page"), "html"), SWEPT)
    return swept.select("page", F.explode(inline_array(F.col("html"), F.col("elements"), F.col("words"))).alias("f")).select("page", "f.*")
