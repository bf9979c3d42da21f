"""Detectors, routing to approval or review, validation of attributes by category schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import cluster_key, gtin, lookup, to_canonical_unit
from factloom.operators.facts import same_value

# What a signal takes off the score, by severity.
WEIGHTS = {"low": 0.05, "medium": 0.15, "high": 0.25, "critical": 0.45}


# Fields of the detectors, dimensions of measured fields, and names that hint at a measure.
CORE = ["title", "base_price", "currency"]
CONFLICTING = ["title", "base_price", "currency", "brand", "chest_inches", "screen_size", "weight"]
SAME_IN_UNITS = {"chest_inches": "length", "weight_grams": "mass", "weight_kg": "mass", "screen_size": "length", "battery_capacity": "energy", "wattage": "power"}
DIMENSIONS = {
    "chest_inches": "length", "screen_size": "length", "weight": "mass", "weight_kg": "mass", "weight_grams": "mass", "volume": "volume", "battery_capacity": "energy", "wattage": "power",
    "voltage": "power", "refresh_rate": "frequency",
}
MEASURE = "capacity|size_(?:cm|in|mm)|weight|length|height|width|depth|screen_size|volume|wattage|voltage"
#: What a signal's cluster is made of besides kind and domain.
CLUSTERS = {"low_confidence_mapping": ["field"], "missing_required_attribute": ["category"], "field_conflict": ["field"], "unit_conflict": ["field"], "category_ambiguous": ["category"], "price_anomaly": ["brand", "category"], "value_contradiction": ["field"]}


def signal(kind: str, severity: str | Column, hit: Column, field: Column | None = None) -> Column:
    """A struct of kind, severity and field where hit holds, else null."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    one = F.struct(F.lit(kind).alias("kind"), level.alias("severity"), (F.lit(None) if field is None else field).cast("string").alias("field"))
    return F.when(F.coalesce(hit, F.lit(False)), one)


def price_is_odd(price: Column, median: Column, samples: Column, high: float = 5.0, low: float = 0.2, least: int = 10) -> Column:
    """Above `high` or below `low` times the median of a cluster of enough samples."""
    return (samples >= least) & ((price > high * median) | (price < low * median))


def gtin_is_odd(gtin: Column) -> Column:
    """No run of 8, 12, 13 or 14 digits."""
    return gtin.isNotNull() & ~gtin.rlike(r"^(\d{8}|\d{12,14})$")


def category_is_ambiguous(path: Column, confidence: Column, least: float = 0.7) -> Column:
    return path.isNull() | (F.coalesce(confidence, F.lit(0.0)) < least)


def variants_are_incomplete(axes: Column, n_variants: Column) -> Column:
    """axes: map of axis to values; fewer variants than combinations."""
    combos = F.aggregate(F.map_values(axes), F.lit(1).cast("long"), lambda n, v: n * F.size(v))
    return (F.size(axes) > 0) & (combos > n_variants)


def low_fields(facts: Column) -> Column:
    """Core fields of a confidence under .70."""
    return F.transform(F.filter(facts, lambda f: f["raw_key"].isin(CORE) & (f["confidence"] < 0.7)), lambda f: f["raw_key"])


def missing_fields(facts: Column, title: Column, price: Column, required: Column) -> tuple[Column, Column]:
    """Core fields of the payload that are missing, and all missing ones: those, and required keys without a fact."""
    none = F.array().cast("array<string>")
    core = F.array_compact(F.array(F.when(F.coalesce(title, F.lit("")) == "", "title"), F.when(price.isNull(), "base_price")))
    return core, F.concat(core, F.array_except(F.coalesce(required, none), F.coalesce(F.transform(facts, lambda f: f["raw_key"]), none)))


def conflicting_fields(facts: Column) -> Column:
    """Comparable fields with an alternative that differs, in the unit's canonical measure where there is one."""

    def differs(f: Column) -> Column:
        others = F.filter(f["alternatives"], lambda x: ~same_value(x, f["value"]))
        dimension = lookup(SAME_IN_UNITS, f["raw_key"])
        own = to_canonical_unit(f["value"].try_cast("double"), f["unit"], dimension)
        alike = F.forall(others, lambda x: F.coalesce(F.abs(to_canonical_unit(x.try_cast("double"), f["unit"], dimension) - own) < 1e-6, F.lit(False)))
        return (F.size(others) > 0) & ~F.coalesce(own.isNotNull() & alike, F.lit(False))

    return F.transform(F.filter(facts, lambda f: f["raw_key"].isin(CONFLICTING) & F.coalesce(differs(f), F.lit(False))), lambda f: f["raw_key"])


def unclear_units(facts: Column) -> Column:
    """Numeric fields of a known dimension whose unit is missing or of no use, and others named like a measure without a unit."""

    def unclear(f: Column) -> Column:
        n, dimension = f["value"].try_cast("double"), lookup(DIMENSIONS, f["raw_key"])
        known = f["unit"].isNull() | to_canonical_unit(n, f["unit"], dimension).isNull()
        return n.isNotNull() & ~f["raw_key"].rlike(r"^variants\[\d+\]\.option\.") & F.when(dimension.isNotNull(), known).otherwise(f["unit"].isNull() & f["raw_key"].rlike(MEASURE))

    return F.transform(F.filter(facts, unclear), lambda f: f["raw_key"])


def contradicting_fields(facts: Column, axes: Column, gtin: Column) -> Column:
    """A colour that no variant has, and a gtin that is none."""
    top = F.get(F.filter(facts, lambda f: f["raw_key"] == "color"), F.lit(0))["value"]
    colors = F.transform(F.try_element_at(axes, F.lit("color")), lambda c: F.lower(F.trim(c)))
    color = (F.size(colors) > 0) & (F.trim(top) != "") & ~F.array_contains(colors, F.lower(F.trim(top)))
    return F.array_compact(F.array(F.when(color, "color"), F.when((gtin != "") & gtin_is_odd(F.trim(gtin)), "gtin")))


def detect(products: DataFrame) -> DataFrame:
    """products with signals: an array of those that fired, in a fixed order.

    Reads facts (array of raw_key, value, unit, confidence, alternatives), the payload's title, price, brand, gtin and
    model, category and category_confidence, required (keys the category asks for), gtin_product and gtin_brand,
    mpn_product and mpn_brand (of the product that has the identifier, null if none: see known_brands), axes (map of
    axis to values), n_variants, and median_price and samples of the price cluster.
    """
    c, facts = F.col, F.col("facts")
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    other = lambda value, kind: (F.coalesce(value, F.lit("")) != "") & c(f"{kind}_product").isNotNull() & (plain(c(f"{kind}_brand")) != plain(c("brand")))
    core, missing = missing_fields(facts, c("title"), c("price"), c("required"))
    first = lambda fields: F.get(fields, F.lit(0))
    some = lambda fields: F.size(fields) > 0
    low, conflicts, units, against = low_fields(facts), conflicting_fields(facts), unclear_units(facts), contradicting_fields(facts, c("axes"), c("gtin"))
    fired = [
        signal("low_confidence_mapping", "medium", some(low), first(low)),
        signal("missing_required_attribute", F.when(some(core), "high").otherwise("medium"), some(missing), first(missing)),
        signal("field_conflict", "high", some(conflicts), first(conflicts)),
        signal("unit_conflict", "medium", some(units), first(units)),
        signal("potential_duplicate", "critical", other(c("gtin"), "gtin") | other(c("model"), "mpn")),
        signal("category_ambiguous", "medium", category_is_ambiguous(c("category"), c("category_confidence"))),
        signal("variant_incomplete", "medium", variants_are_incomplete(c("axes"), c("n_variants"))),
        signal("price_anomaly", "high", price_is_odd(c("price"), c("median_price"), c("samples"))),
        signal("value_contradiction", "high", some(against), first(against)),
    ]
    return products.withColumn("signals", F.array_compact(F.array(*fired)))


def known_brands(products: DataFrame, identities: DataFrame, brands: DataFrame) -> DataFrame:
    """products (gtin, model) with gtin_product, gtin_brand, mpn_product, mpn_brand of known identities (type, value,
    product) and brands (product, brand); of several products with an identity the least."""
    one = identities.groupBy("type", "value").agg(F.min("product").alias("_product")).join(brands.select(F.col("product").alias("_product"), F.col("brand").alias("_brand")), "_product", "left")
    for kind, column in (("gtin", gtin(F.col("gtin"))), ("mpn", F.nullif(F.trim("model"), F.lit("")))):
        side = one.filter(F.col("type") == kind).select(F.col("value").alias("_value"), F.col("_product").alias(f"{kind}_product"), F.col("_brand").alias(f"{kind}_brand"))
        products = products.withColumn("_key", column).join(side, F.col("_key") == F.col("_value"), "left").drop("_key", "_value")
    return products


def signal_cluster(kind: Column, domain: Column, dims: dict[str, Column]) -> Column:
    """Cluster key of a signal: its kind, its domain and what else its kind groups by; an unknown category is (none)."""
    dims = {k: v.cast("string") for k, v in dims.items()}
    out = F.when(kind.isNull(), None)
    for name in [*CLUSTERS, None]:
        own = {k: dims[k] for k in CLUSTERS.get(name, [])}
        if name == "category_ambiguous":
            own["category"] = F.coalesce(own["category"], F.lit("(none)"))
        if name == "missing_required_attribute":
            own["category"] = F.coalesce(own["category"], F.lit(""))
        key = cluster_key({"signal_kind": kind, "domain": domain, **own})
        out = out.otherwise(key) if name is None else out.when(kind == name, key)
    return out


def route(detected: DataFrame) -> DataFrame:
    """With decision (auto without signals, else review) and score (1 less the signals' weights, 0 at least)."""
    weight = lambda s: F.coalesce(*[F.when(s["severity"] == k, v) for k, v in WEIGHTS.items()])
    score = F.round(F.greatest(F.lit(0.0), F.aggregate("signals", F.lit(1.0), lambda n, s: n - weight(s))), 9)
    return detected.withColumn("score", score).withColumn("decision", F.when(F.size("signals") == 0, "auto").otherwise("review"))


def validate(records: DataFrame, rules: DataFrame) -> DataFrame:
    """id, valid, missing, errors of records (id, category, attributes map<string,string>).

    rules: category, tier, key, keyword, arg; keywords are required, type (string, number, integer, boolean),
    enum (values joined by |), minimum, maximum, exclusiveMinimum, multipleOf, const, pattern, and any other fails. Every
    rule is tried (schemas.check_records has all keywords, on nested records). Records whose category has no rule, or none of the authoritative tier, are valid.
    """
    strict = rules.filter("tier = 'authoritative'").groupBy("category").agg(F.sort_array(F.collect_list(F.struct("key", "keyword", "arg"))).alias("rules"))
    both = records.select("id", "category", "attributes").join(strict, "category", "left")
    a = F.col("attributes")

    def broken(r: Column) -> Column:
        v = F.try_element_at(a, r["key"])
        n, arg = v.try_cast("double"), r["arg"]
        kinds = F.when(arg == "number", n.isNull()).when(arg == "integer", n.isNull() | (n != F.floor(n))).when(arg == "boolean", ~v.isin("true", "false")).otherwise(False)
        bad = (
            F.when(r["keyword"] == "type", kinds)
            .when(r["keyword"] == "enum", ~F.array_contains(F.split(arg, r"\|"), v))
            .when(r["keyword"] == "minimum", n < arg.try_cast("double"))
            .when(r["keyword"] == "maximum", n > arg.try_cast("double"))
            .when(r["keyword"] == "exclusiveMinimum", n <= arg.try_cast("double"))
            .when(r["keyword"] == "multipleOf", F.pmod(n, arg.try_cast("double")) != 0)
            .when(r["keyword"] == "const", v != arg)
            .when(r["keyword"] == "pattern", ~F.rlike(v, arg))
            .otherwise(F.raise_error(F.concat(F.lit("unknown keyword: "), r["keyword"])).cast("boolean"))
        )
        return v.isNotNull() & F.coalesce(bad, F.lit(False))

    missing = F.transform(F.filter("rules", lambda r: (r["keyword"] == "required") & F.try_element_at(a, r["key"]).isNull()), lambda r: r["key"])
    errors = F.transform(F.filter("rules", lambda r: (r["keyword"] != "required") & broken(r)), lambda r: F.concat_ws(":", r["key"], r["keyword"]))
    none = F.array().cast("array<string>")
    out = both.select("id", F.coalesce(missing, none).alias("missing"), F.coalesce(errors, none).alias("errors"))
    return out.select("id", ((F.size("missing") == 0) & (F.size("errors") == 0)).alias("valid"), "missing", "errors")


def with_overlay(rules: DataFrame, overlay: DataFrame, tenant: str) -> DataFrame:
    """Rules of all, and those that a tenant's overlay (tenant and the columns of rules) adds: both have to hold.

    An overlay's rules count for the category's tier; they can't make a category strict that isn't.
    """
    tiers = rules.groupBy("category").agg(F.min("tier").alias("tier"))
    own = overlay.filter(F.col("tenant") == tenant).drop("tenant", "tier").join(tiers, "category")
    return rules.unionByName(own.select(rules.columns)).distinct()
