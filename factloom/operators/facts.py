"""Fact algebra: precedence merge, cross-validation, mapping onto canonical attributes, canonical payloads.

A fact is a row: page, raw_key, value (text), confidence, parser, ordinal (its place of arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import host_of, lookup, tld

# Rank of a parser's facts by family of field; and the order in which parsers arrive.
PARSERS = ["json_ld", "shopify_probe", "shopify_products_json", "next_data", "microdata", "rdfa", "nuxt", "initial_state", "magento", "woocommerce", "algolia", "opengraph", "breadcrumb_list"]
PRECEDENCE = {
    "identifier": [5, 5, 5, 4, 3, 3, 3, 3, 3, 2, 2, 1, 0],
    "price": [5, 5, 5, 4, 3, 3, 3, 3, 3, 2, 2, 2, 0],
    "inventory": [1, 5, 4, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0],
    "variants": [4, 5, 5, 5, 2, 2, 2, 2, 1, 1, 0, 0, 0],
    "attribute": [5, 2, 2, 3, 3, 3, 2, 2, 2, 1, 1, 1, 0],
    "category": [3, 2, 2, 5, 3, 2, 2, 2, 2, 1, 1, 1, 2],
    "text": [5, 5, 5, 4, 3, 3, 3, 3, 3, 2, 2, 2, 0],
}
ARRIVAL = ["json_ld", "shopify_probe", "next_data", "microdata", "opengraph", "nuxt", "initial_state", "magento", "woocommerce", "algolia", "shopify_products_json", "rdfa", "breadcrumb_list"]
# Currency of a top-level domain.
TLD_CURRENCY = {
    "in": "INR", "au": "AUD", "uk": "GBP", "ca": "CAD", "jp": "JPY", "de": "EUR", "fr": "EUR", "it": "EUR", "es": "EUR", "nl": "EUR", "ie": "EUR", "nz": "NZD", "ch": "CHF",
    "se": "SEK", "no": "NOK", "dk": "DKK", "sg": "SGD",
}
# Raw keys of the core fields, and the weights and bands of the mapping score.
CORE_FIELDS = {
    "title": "title", "brand": "brand", "vendor": "brand", "gtin": "gtin", "barcode": "gtin", "model_number": "modelNumber", "modelNumber": "modelNumber", "mpn": "modelNumber",
    "description": "description", "base_price": "basePrice", "price": "basePrice", "currency": "currency", "category_path": "canonicalCategory", "productType": "canonicalCategory", "images": "images",
}
#: Fields whose sources are held against each other.
COMPARED = ["base_price", "title", "brand", "gtin", "model_number"]
SCORE_WEIGHTS = {"channel": 0.40, "synonym": 0.18, "embedding": 0.15, "type": 0.10, "unit": 0.07, "category": 0.06, "tenant": 0.04}
BANDS = (("auto", 0.55), ("auto_warn", 0.45), ("suggestion", 0.25))


def field_family(key: Column) -> Column:
    """Family of a raw key, by which parsers are ranked."""
    return (
        F.when(key.rlike(r"^variants\[\d+\]\.inventory_quantity$"), "inventory")
        .when(key.rlike(r"^variants\[\d+\]\.price$"), "price")
        .when(key.rlike(r"^variants\[\d+\]"), "variants")
        .when(key.isin("gtin", "sku", "mpn", "model_number", "barcode"), "identifier")
        .when(key.isin("base_price", "currency", "mrp"), "price")
        .when(key == "productType", "category")
        .when(key.isin("title", "description", "brand", "images"), "text")
        .otherwise("attribute")
    )


def precedence(key: Column, parser: Column) -> Column:
    """Rank of a parser for a key; an unknown parser has 0."""
    ranks = {f"{family}/{p}": r for family, row in PRECEDENCE.items() for p, r in zip(PARSERS, row, strict=True)}
    return F.coalesce(lookup(ranks, F.concat(field_family(key), F.lit("/"), parser)), F.lit(0))


def same_value(a: Column, b: Column) -> Column:
    """Numbers within 1e-6, other texts trimmed and in lower case; nulls equal nulls."""
    x, y = a.try_cast("double"), b.try_cast("double")
    numbers = x.isNotNull() & y.isNotNull()
    return F.when(numbers, F.abs(x - y) <= 1e-6).otherwise(F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b))))


def merge_facts(facts: DataFrame) -> DataFrame:
    """One fact per page and raw key: highest precedence, then confidence, then first arrival.

    alternatives holds the values of the others that differ from the winner's, in rank order. Facts of a
    page and key are few (a row per parser), so their window is small.
    """
    rank = precedence(F.col("raw_key"), F.col("parser"))
    w = Window.partitionBy("page", "raw_key").orderBy(F.desc("_rank"), F.desc("confidence"), "ordinal")
    ranked = facts.withColumn("_rank", rank).withColumn("_nth", F.row_number().over(w))
    one = F.struct("_nth", "value", "parser", "confidence", "ordinal")
    grouped = ranked.groupBy("page", "raw_key").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    top = F.col("_all")[0]
    others = F.filter(F.slice(F.col("_all"), 2, F.greatest(F.size("_all") - 1, F.lit(0))), lambda x: ~same_value(x["value"], top["value"]))
    return grouped.select("page", "raw_key", top["value"].alias("value"), top["parser"].alias("parser"), top["confidence"].alias("confidence"), F.transform(others, lambda x: x["value"]).alias("alternatives"))


def infer_currency(facts: DataFrame, pages: DataFrame, page: str = "page_id") -> DataFrame:
    """facts, and for each of pages without a currency among them that of its url's top-level domain (.70).

    pages: page, url, a row per page; a page without a fact gets one too. A url without a host, or of another domain,
    adds nothing.
    """
    having = facts.filter("raw_key = 'currency'").select("page").distinct()
    urls = pages.select(F.col(page).alias("page"), lookup(TLD_CURRENCY, tld(host_of(F.col("url")))).alias("value")).filter("value is not null")
    inferred = urls.join(having, "page", "left_anti").select("page", F.lit("currency").alias("raw_key"), "value", F.lit(0.70).alias("confidence"), F.lit("inferred").alias("parser"), F.lit(1_000_000).alias("ordinal"))
    return facts.select("page", "raw_key", "value", "confidence", "parser", "ordinal").unionByName(inferred)


def fill_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """All facts of first, and those of second whose page and raw key first lacks: site parsers before general ones."""
    return first.unionByName(second.join(first.select("page", "raw_key").distinct(), ["page", "raw_key"], "left_anti").select(*first.columns))


def best_fact(facts: DataFrame, by: list[str]) -> DataFrame:
    """The most confident fact per key, the first of equals."""
    return facts.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("confidence"), "ordinal"))).filter("_nth = 1").drop("_nth")


def cross_validate(facts: DataFrame, boost: float = 0.05, penalty: float = 0.12) -> DataFrame:
    """page, raw_key, value, confidence, sources, conflict of un-merged facts.

    Of the comparable fields the first fact of each parser counts: where all of several parsers agree confidence
    rises by `boost` for each further one (1 at most); where they don't it falls by `penalty` (0 at least). The value
    is the most confident one. Facts of other keys are carried as they are, the first of each parser.
    """
    n = F.round(F.col("value").try_cast("double"), 6)
    own = facts.groupBy("page", "raw_key", "parser").agg(F.min_by(F.struct("value", "confidence"), F.struct("ordinal", -F.col("confidence"), "value")).alias("v"), F.min("ordinal").alias("ordinal"))
    own = own.select("page", "raw_key", "v.*", "ordinal", F.col("raw_key").isin(COMPARED).alias("compared"))
    one = own.filter("compared").withColumn("plain", F.when(n.isNotNull(), n.cast("string")).otherwise(F.lower(F.trim("value"))))
    g = one.groupBy("page", "raw_key").agg(F.max_by("value", F.struct("confidence", -F.col("ordinal"))).alias("value"), F.max("confidence").alias("best"), F.count("*").alias("sources"), F.countDistinct("plain").alias("values"))
    agreed = F.least(F.lit(1.0), F.col("best") + boost * (F.col("sources") - 1))
    confidence = F.when(F.col("values") > 1, F.greatest(F.lit(0.0), F.col("best") - penalty)).otherwise(agreed)
    out = g.select("page", "raw_key", "value", F.round(confidence, 9).alias("confidence"), "sources", (F.col("values") > 1).alias("conflict"))
    carried = own.filter("not compared").select("page", "raw_key", "value", "confidence")
    return out.unionByName(carried.withColumns({"sources": F.lit(1).cast("long"), "conflict": F.lit(False)}))


def mapping_score(signals: dict[str, Column]) -> Column:
    """Weighted sum of signals in 0 to 1, at most 1; a missing signal is 0."""
    parts = [F.coalesce(signals[k].cast("double"), F.lit(0.0)) * w for k, w in SCORE_WEIGHTS.items() if k in signals]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(F.lit(1.0), total)


def approval_band(score: Column, bands: tuple = BANDS) -> Column:
    out = F.when(score >= bands[0][1], bands[0][0])
    for name, least in bands[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("unmapped")


def type_fit(kind: Column, value_kind: Column, numeric: Column) -> Column:
    """1 where a value's kind is the attribute's, .3 where not, .5 for an attribute of no known kind; a text that is a
    number (numeric) suits a number."""
    fits = F.when(kind == "number", (value_kind == "number") | numeric).otherwise(kind == value_kind)
    return F.when(kind.isin("string", "number", "boolean", "array", "object"), F.when(F.coalesce(fits, F.lit(False)), 1.0).otherwise(0.3)).otherwise(0.5)


def unit_fit(unit_type: Column, allowed: Column, unit: Column) -> Column:
    """1 without a constraint or for an allowed unit, .5 for a missing one, .2 for another."""
    return F.when(unit_type.isNull(), 1.0).when(unit.isNull(), 0.5).when((F.size(allowed) == 0) | F.array_contains(allowed, unit), 1.0).otherwise(0.2)


def category_fit(scope: Column, category: Column) -> Column:
    """1 for an attribute of all categories or of an ancestor, .5 for an unknown category, .2 for another."""
    return F.when(F.size(scope) == 0, 1.0).when(category.isNull(), 0.5).when(F.exists(scope, lambda s: category.startswith(s)), 1.0).otherwise(0.2)


def channel_index(channel: DataFrame) -> DataFrame:
    """path, category, canonical_key: of mappings (ordinal, category or *, source_path, canonical_key) of one path, as
    it stands and as its leaf ($. and brackets cut), for a category or for all, the last."""
    leaf = F.regexp_replace(F.regexp_replace("source_path", r"^\$\.", ""), r"\[.*", "")
    paths = channel.withColumn("path", F.explode(F.array_distinct(F.array(F.col("source_path"), leaf))))
    return paths.groupBy("path", "category").agg(F.max(F.struct("ordinal", "canonical_key")).alias("m")).select("path", "category", "m.ordinal", "m.canonical_key")


def map_facts(facts: DataFrame, channel: DataFrame, synonyms: DataFrame, overrides: DataFrame, attributes: DataFrame, top: int = 3) -> DataFrame:
    """facts (category, raw_key, source_pointer, value, value_kind, unit, ...) with canonical_key, score, band, candidates.

    channel: ordinal, category (or *), source_path, canonical_key; synonyms: synonym, canonical_key (any case);
    overrides: raw_key, canonical_key, priority: the highest is approved outright; attributes: canonical_key,
    data_type, unit_type, allowed_units, category_scope. The channel's key is that of the raw key, or else of the
    source pointer, the last mapping for the category or for all; a synonym's key is a candidate if it is another.
    An attribute that isn't defined fits by a half. candidates are the `top` best (key, score), of equals the
    channel's first. Variant paths have none. Reference tables are joined by key; Spark broadcasts small ones.
    """
    # what a fact's candidates depend on is its key: equal facts are mapped once, and a rerun gives the same keys
    numeric = F.col("value").try_cast("double").isNotNull().alias("numeric")
    ids = facts.withColumn("_id", F.struct("category", "raw_key", "source_pointer", "value_kind", numeric, "unit"))
    asked = ids.filter(~F.col("raw_key").startswith("variants[")).select("_id").distinct().select("_id", "_id.*")
    index = channel_index(channel).withColumnRenamed("category", "_cat")
    paths = asked.select("_id", "category", F.posexplode(F.array("raw_key", "source_pointer")).alias("_nth", "path"))
    here = paths.join(index, "path").filter((F.col("_cat") == F.col("category")) | (F.col("_cat") == "*"))
    # the raw key's mapping before the pointer's; of one path's the last
    by_channel = here.groupBy("_id").agg(F.min_by("canonical_key", F.struct("_nth", (-F.col("ordinal")).alias("o"))).alias("canonical_key")).withColumn("channel", F.lit(1.0))
    s = synonyms.groupBy(F.lower("synonym").alias("_low")).agg(F.min("canonical_key").alias("canonical_key"))
    by_synonym = asked.withColumn("_low", F.lower("raw_key")).join(s, "_low").select("_id", "canonical_key", F.lit(0.0).alias("channel"))
    by_synonym = by_synonym.join(by_channel.select("_id", "canonical_key"), ["_id", "canonical_key"], "left_anti")
    found = by_channel.select("_id", "canonical_key", "channel").unionByName(by_synonym).join(asked.select("_id", "category", "value_kind", "numeric", "unit"), "_id").join(attributes, "canonical_key", "left")
    known = F.col("data_type").isNotNull()
    half = lambda x: F.when(known, x).otherwise(0.5)
    signals = {
        "channel": F.col("channel"), "synonym": 1.0 - F.col("channel"), "type": half(type_fit(F.col("data_type"), F.col("value_kind"), F.col("numeric"))),
        "unit": half(unit_fit(F.col("unit_type"), F.col("allowed_units"), F.col("unit"))), "category": half(category_fit(F.col("category_scope"), F.col("category"))),
    }
    scored = found.withColumn("score", F.round(mapping_score(signals), 9))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (1 - F.col("channel")).alias("c"), F.col("canonical_key").alias("key"))))
    lists = scored.groupBy("_id").agg(F.slice(best, 1, top).alias("_best"))
    o = overrides.groupBy("raw_key").agg(F.max_by("canonical_key", F.struct("priority", "canonical_key")).alias("_forced")).filter("not startswith(raw_key, 'variants[')")
    out = ids.join(lists, "_id", "left").join(o, "raw_key", "left")
    forced, first = F.col("_forced").isNotNull(), F.get("_best", F.lit(0))
    score = F.when(forced, 1.0).otherwise(F.coalesce(-first["s"], F.lit(0.0)))
    band = F.when(forced, "override").otherwise(approval_band(score))
    own = F.transform("_best", lambda b: F.struct(b["key"].alias("key"), (-b["s"]).alias("score")))
    candidates = F.when(forced, F.array(F.struct(F.col("_forced").alias("key"), F.lit(1.0).alias("score")))).otherwise(own)
    key = F.when(forced, F.col("_forced")).when(band != "unmapped", first["key"])
    return out.select(*facts.columns, key.alias("canonical_key"), score.alias("score"), band.alias("band"), candidates.alias("candidates"))


def core_field(key: Column) -> Column:
    """Core field of a raw key, or null."""
    return lookup(CORE_FIELDS, key)


def with_core_fallback(facts: DataFrame, least: float = 0.85, score: float = 0.95) -> DataFrame:
    """facts with the core field of their raw key where they aren't mapped: canonical_key, method, candidates, approved.

    What is mapped stays; of the others with a core field, a method or candidates that are there stay too, and those of
    `least` confidence are approved. Reads raw_key, confidence and these four (candidates: array of key, score).
    """
    field = core_field(F.col("raw_key"))
    fits = F.col("canonical_key").isNull() & field.isNotNull()
    one = F.array(F.struct(field.alias("key"), F.lit(score).alias("score")))
    return facts.withColumns({
        "canonical_key": F.coalesce("canonical_key", field),
        "method": F.when(fits, F.coalesce("method", F.lit("core_field"))).otherwise(F.col("method")),
        "candidates": F.when(fits, F.coalesce("candidates", one)).otherwise(F.col("candidates")),
        "approved": F.when(fits, F.col("confidence") >= least).otherwise(F.col("approved")),
    })


def first_fact_per_path(facts: DataFrame, by: list[str]) -> DataFrame:
    """Of each by and canonical path the most confident fact, in order of path, those without one last and by raw key.

    Reads canonical_key, raw_key, confidence and ordinal, which decides ties; place is the fact's number within by, from 1.
    """
    path = F.struct(F.col("canonical_key").isNull().alias("last"), F.coalesce("canonical_key", "raw_key").alias("path"))
    rest = [c for c in facts.columns if c not in by]
    best = facts.withColumn("_path", path).groupBy(*by, "_path").agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col("ordinal"))).alias("f"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_path"))
    return best.withColumn("place", place).select(*by, "f.*", "place")


def canonical_payload(facts: DataFrame) -> DataFrame:
    """One row per page: core fields, each the most confident fact's, and a map of the other attributes.

    Currencies are in upper case; variant paths take no part.
    """
    plain = facts.filter(~F.col("raw_key").startswith("variants[")).withColumn("field", core_field(F.col("raw_key")))
    names = list(dict.fromkeys(CORE_FIELDS.values()))
    best = F.struct("confidence", -F.col("ordinal"))
    one = lambda n: F.max_by(F.upper("value") if n == "currency" else F.col("value"), F.when(F.col("field") == n, best)).alias(n)
    # attributes are reduced to one fact a key before they are gathered
    per_key = plain.groupBy("page", F.when(F.col("field").isNull(), F.col("raw_key")).alias("attribute"), "field").agg(F.max_by("value", best).alias("value"), F.max("confidence").alias("confidence"), F.min(F.struct(-F.col("confidence"), "ordinal")).getField("ordinal").alias("ordinal"))
    entry = F.when(F.col("attribute").isNotNull(), F.struct(F.col("attribute").alias("key"), "value"))
    attributes = F.array_sort(F.collect_list(entry))
    return per_key.groupBy("page").agg(*[one(n) for n in names], F.when(F.size(attributes) > 0, F.map_from_entries(attributes)).alias("attributes"))


def extract_variants(facts: DataFrame, options: DataFrame) -> DataFrame:
    """page, variant, sku, barcode, price, axes, variant_key of facts (page, category, raw_key, value, ...).

    axes are those that the category's schema names (options: category, axes) and, for a category without a schema, all
    options of the variant. The key is a hash of the axes, in lower case, sorted: equal combinations have equal keys.
    """
    named = facts.groupBy("page").agg(F.max("category").alias("category")).join(options, "category", "left").select("page", F.col("axes").alias("_axes"))
    v = variants(facts).join(named, "page", "left")
    axes = F.when(F.size("_axes") > 0, F.map_filter("options", lambda k, x: F.array_contains("_axes", k))).otherwise(F.col("options"))
    low = F.array_sort(F.transform(F.map_entries("axes"), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.lower(F.trim(e["value"])).alias("value"))))
    key = F.substring(F.sha2(F.to_json(F.map_from_entries(low)), 256), 1, 16)
    one = lambda name: F.try_element_at("fields", F.lit(name))
    return v.withColumn("axes", axes).select("page", "variant", one("sku").alias("sku"), one("barcode").alias("barcode"), one("price").try_cast("double").alias("price"), "axes", key.alias("variant_key"))


def parent_fields(facts: DataFrame) -> DataFrame:
    """page, fields: a map of canonical key to value of the mapped facts beside variants; of several the last."""
    own = facts.filter(~F.col("raw_key").startswith("variants[") & F.col("canonical_key").isNotNull())
    last = own.groupBy("page", "canonical_key").agg(F.max_by("value", "ordinal").alias("value"))
    return last.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("canonical_key").alias("key"), "value")))).alias("fields"))


def variants(facts: DataFrame) -> DataFrame:
    """page, variant, fields (map), options (map) from paths like variants[0].price and variants[0].option.size."""
    v = facts.withColumn("variant", F.regexp_extract("raw_key", r"^variants\[(\d+)\]\.", 1).try_cast("int")).filter("variant is not null")
    v = v.withColumn("field", F.regexp_extract("raw_key", r"^variants\[\d+\]\.(?:option\.)?(.+)$", 1)).withColumn("is_option", F.col("raw_key").rlike(r"^variants\[\d+\]\.option\."))
    best = best_fact(v, ["page", "variant", "is_option", "field"])
    entry = F.struct(F.col("field").alias("key"), "value")
    as_map = lambda flag: F.map_from_entries(F.array_sort(F.collect_list(F.when(flag, entry))))
    return best.groupBy("page", "variant").agg(as_map(~F.col("is_option")).alias("fields"), as_map(F.col("is_option")).alias("options"))
