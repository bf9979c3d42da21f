"""Facts from the JSON-LD products of a page, and category paths from its breadcrumbs; SQL functions on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.html import breadcrumb, readable, script_blocks
from factloom.functions.records import fact, facts_with_values, full, get, number, plain
from factloom.functions.scalars import OFFER_CURRENCY, host_of, let, lookup, slug, tld

# Members and raw keys, in order; those of variants; the order of identifiers; confidences.
TEXTS = [("sku", "sku"), ("mpn", "mpn"), ("model", "model_number"), ("description", "description"), ("color", "color"), ("material", "material"), ("weight", "weight"), ("pattern", "pattern")]
GTINS, VARIANT_GTINS = ["gtin13", "gtin12", "gtin14", "gtin8", "gtin"], ["gtin13", "gtin14", "gtin12", "gtin8", "gtin"]
OPTIONS = ["color", "size", "material", "pattern"]
CONFIDENCE, CRUMB_CONFIDENCE, CRUMB_STEP = 0.95, 0.50, 0.10

_STRINGS = "array<string>"
_FACT = "array<struct<raw_key:string,value:string,confidence:double,method:string>>"


def items(html: Column) -> Column:
    """JSON-LD objects of a page as texts, in order; arrays are flattened one level, what is no JSON gives nothing."""
    each = F.transform(script_blocks(html), lambda b: F.when(F.trim(b).startswith("["), F.from_json(b, _STRINGS)).otherwise(F.array(b)))
    flat = F.flatten(F.filter(each, lambda x: x.isNotNull()))
    return F.filter(flat, lambda x: F.coalesce(get(x, "$"), F.lit("")).startswith("{"))


def scalar(text: Column) -> Column:
    """A text that is neither blank nor an object nor an array."""
    return F.when(~full(text).rlike(r"^[\[{]"), full(text))


def listed(json: Column) -> Column:
    """The members of an array as texts, or null."""
    return F.when(F.trim(json).startswith("["), F.from_json(json, _STRINGS))


def of_type(found: Column, kind: str) -> Column:
    return F.filter(found, lambda x: get(x, "$['@type']") == kind)


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def offer(j: Column, currency: Column) -> Column:
    """The offer of the preferred currency, or else the first; those of an aggregate are its own."""
    raw = get(j, "$.offers")
    inner = F.when(get(raw, "$['@type']") == "AggregateOffer", listed(get(raw, "$.offers")))
    each = F.filter(F.coalesce(listed(raw), inner, F.array(raw)), lambda o: F.trim(o).startswith("{"))
    return F.coalesce(first(F.filter(each, lambda o: F.upper(get(o, "$.priceCurrency")) == currency)), first(each))


def breadcrumbs(found: Column) -> Column:
    """Names of the first breadcrumb list, in the order they stand."""
    names = F.transform(listed(get(first(of_type(found, "BreadcrumbList")), "$.itemListElement")), lambda i: scalar(get(i, "$.name")))
    return F.filter(names, lambda n: n.isNotNull())


def product_path(names: Column, title: Column) -> Column:
    """Breadcrumb names joined by slashes, without a last one that is the product: equal to its title, or three words
    or more of it."""
    leaf, name = F.lower(F.trim(F.element_at(names, -1))), F.lower(F.trim(title))
    own = (leaf == name) | ((F.size(F.split(leaf, r"\s+")) >= 3) & name.contains(leaf))
    kept = F.when((F.size(names) > 1) & F.coalesce(own, F.lit(False)), F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)
    return F.when(F.size(names) > 0, F.array_join(kept, "/"))


def product(found: Column, url: Column) -> Column:
    """Facts of a page's product group, or else of its best product: one with sizes, one with offers, the first."""
    products = of_type(found, "Product")
    group = first(of_type(found, "ProductGroup"))
    sized = F.filter(products, lambda p: F.json_array_length(get(p, "$.size")) > 0)
    offered = F.filter(products, lambda p: get(p, "$.offers").isNotNull())
    best = F.coalesce(group, first(sized), first(offered), first(products))
    currency = lookup(OFFER_CURRENCY, tld(host_of(url)))

    def of(j: Column) -> Column:
        one = lambda key, value: fact(key, value, CONFIDENCE)
        brand = F.coalesce(scalar(get(j, "$.brand.name")), scalar(get(j, "$.brand")))
        gtin = F.coalesce(*[scalar(get(j, f"$.{g}")) for g in GTINS])
        texts = [one("title", scalar(get(j, "$.name"))), one("brand", brand), one("gtin", gtin), *[one(k, scalar(get(j, f"$.{m}"))) for m, k in TEXTS]]
        texts += [one("gender", scalar(get(j, "$.audience.suggestedGender"))), *[one(k, plain(number(get(j, f"$.aggregateRating.{m}")))) for m, k in (("ratingValue", "rating"), ("reviewCount", "review_count"))]]
        extra = F.transform(listed(get(j, "$.additionalProperty")), lambda e: one(F.nullif(slug(get(e, "$.name")), F.lit("")), F.coalesce(get(e, "$.value"), get(e, "$.unitText"))))
        price = let(offer(j, currency), lambda o: F.array(one("base_price", plain(number(get(o, "$.price")))), one("currency", scalar(get(o, "$.priceCurrency")))).cast(_FACT))
        image = get(j, "$.image")
        urls = F.filter(F.transform(F.coalesce(listed(image), F.array(image)), lambda x: F.coalesce(get(x, "$.url"), x)), lambda u: u.startswith("http"))
        images = F.array(one("images", F.when(F.size(urls) > 0, F.to_json(urls))))
        named = F.filter(F.coalesce(extra.cast(_FACT), F.array().cast(_FACT)), lambda f: f["raw_key"].isNotNull())
        return facts_with_values(F.array(*texts), named, price, images)

    def variants(children: Column) -> Column:
        def each(c: Column, i: Column) -> Column:
            at = lambda name: F.concat(F.lit("variants["), i.cast("string"), F.lit("]." + name))
            own = [fact(at("option." + o), scalar(get(c, f"$.{o}")), CONFIDENCE) for o in OPTIONS]
            own += [fact(at("sku"), scalar(get(c, "$.sku")), CONFIDENCE), fact(at("gtin"), F.coalesce(*[scalar(get(c, f"$.{g}")) for g in VARIANT_GTINS]), CONFIDENCE)]
            own += [fact(at("barcode"), F.coalesce(*[scalar(get(c, f"$.{g}")) for g in VARIANT_GTINS[:2]]), CONFIDENCE), fact(at("price"), plain(number(get(offer(c, currency), "$.price"))), CONFIDENCE)]
            return F.array(*own).cast(_FACT)

        return F.flatten(F.transform(F.filter(children, lambda c: F.trim(c).startswith("{")), each))

    def sizes(j: Column) -> Column:
        raw = get(j, "$.size")
        at = lambda i: F.concat(F.lit("variants["), i.cast("string"), F.lit("].option.size"))
        return F.transform(F.coalesce(listed(raw), F.when(scalar(raw).isNotNull(), F.array(raw))), lambda s, i: fact(at(i), s, CONFIDENCE)).cast(_FACT)

    children = listed(get(group, "$.hasVariant"))
    own = F.when(F.size(children) > 0, variants(children)).otherwise(let(best, sizes))
    path = F.array(fact("productType", product_path(breadcrumbs(found), get(best, "$.name")), CONFIDENCE))
    return facts_with_values(let(best, of), own, path)


def crumb_facts(found: Column) -> Column:
    """The category path of the first breadcrumb list by position, a fact whose confidence grows with its depth."""
    raw = listed(get(first(of_type(found, "BreadcrumbList")), "$.itemListElement"))
    named = F.filter(raw, lambda i: scalar(F.coalesce(get(i, "$.name"), get(i, "$.item.name"))).isNotNull())
    crumbs = F.transform(named, lambda i: F.struct(get(i, "$.position").alias("position"), F.coalesce(get(i, "$.name"), get(i, "$.item.name")).alias("name")))
    depth = F.least(F.size(crumbs) - 1, F.lit(4))
    path = F.when(F.size(crumbs) > 1, breadcrumb(crumbs))
    one = F.struct(F.lit("category_path").alias("raw_key"), path.alias("value"), F.round(F.lit(CRUMB_CONFIDENCE) + CRUMB_STEP * depth, 2).alias("confidence"), F.lit("direct").alias("method"))
    return facts_with_values(F.array(one))


def jsonld_array(html: Column, url: Column) -> Column:
    """FOUND of a page's linked data: its product, and the breadcrumb list."""
    row = lambda parser, offset: lambda f, i: F.struct(f["raw_key"].alias("raw_key"), f["value"].alias("value"), f["confidence"].alias("confidence"), F.lit(parser).alias("parser"), (i + offset).alias("ordinal"))
    facts = lambda found: F.when(F.size(found) > 0, F.concat(F.transform(product(found, url), row("json_ld", 0)), F.transform(crumb_facts(found), row("breadcrumb_list", 95_000))))
    return let(F.when(html.rlike("(?i)application/ld\\+json"), items(html)), facts)


def jsonld_facts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, raw_key, value, confidence, parser (json_ld, breadcrumb_list), ordinal of captcha-free pages (html, url)."""
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    return readable(pages).select(F.col(page).alias("page"), F.explode(jsonld_array(F.col("html"), url)).alias("f")).select("page", "f.*")
