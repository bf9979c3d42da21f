"""Fact algebra, policy and resolution on rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import facts as X
from factloom.operators import policy as P
from factloom.operators import resolve as R
from factloom.operators import review as V
from factloom.plans.fixtures import values
from factloom.plans.register import query
from factloom.sources.store import diff_fields, upsert
from factloom.sources.tables import table


def line_facts(spark, sf_dir):
    """Facts of line items: an order is a page, the parser is by line number, the value a rounded discount."""
    parser = F.element_at(F.array(*[F.lit(p) for p in ("json_ld", "microdata", "opengraph", "nuxt")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    key = F.when(F.col("l_suppkey") % 3 == 0, "title").when(F.col("l_suppkey") % 3 == 1, "base_price").otherwise("colour")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), key.alias("raw_key"), F.col("l_discount").cast("decimal(6,2)").cast("string").alias("value"), F.round(F.col("l_quantity") / 100, 2).alias("confidence"), parser.alias("parser"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ordinal")
    )


_FACTS = """
    f AS (SELECT l_orderkey AS page, CASE l_suppkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'base_price' ELSE 'colour' END AS raw_key,
                 l_discount::DECIMAL(6,2)::VARCHAR AS value, round(l_quantity / 100, 2) AS confidence,
                 CASE l_linenumber % 4 WHEN 0 THEN 'json_ld' WHEN 1 THEN 'microdata' WHEN 2 THEN 'opengraph' ELSE 'nuxt' END AS parser, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ordinal FROM lineitem)
"""


@query(
    "merge_facts",
    f"""
    WITH {_FACTS},
         k AS (SELECT *, CASE parser WHEN 'json_ld' THEN 5 WHEN 'microdata' THEN 3 WHEN 'opengraph' THEN CASE raw_key WHEN 'colour' THEN 1 ELSE 2 END ELSE CASE raw_key WHEN 'colour' THEN 2 ELSE 3 END END AS r FROM f),
         n AS (SELECT *, row_number() OVER (PARTITION BY page, raw_key ORDER BY r DESC, confidence DESC, ordinal) AS nth FROM k),
         w AS (SELECT * FROM n WHERE nth = 1)
    SELECT w.page, w.raw_key, w.value, w.parser, w.confidence,
           coalesce((SELECT string_agg(n.value, '|' ORDER BY n.nth) FROM n WHERE n.page = w.page AND n.raw_key = w.raw_key AND n.nth > 1 AND abs(n.value::DOUBLE - w.value::DOUBLE) > 1e-6), '') AS alternatives
    FROM w
    """,
)
def merge_facts(spark, sf_dir):
    return X.merge_facts(line_facts(spark, sf_dir)).withColumn("alternatives", F.array_join("alternatives", "|"))


_RANKS = values([(family, parser, rank) for family, row in X.PRECEDENCE.items() for parser, rank in zip(X.PARSERS, row, strict=True)], "family, parser, rank")
_KEYS = ["gtin", "mrp", "variants[0].inventory_quantity", "variants[1].sku", "colour", "productType", "brand", "variants[2].price", "category_path"]
_FAMILIES = ["identifier", "price", "inventory", "variants", "attribute", "category", "text", "price", "attribute"]


@query(
    "merge_precedence",
    f"""
    WITH f AS (SELECT l_orderkey AS page, l_partkey % {len(_KEYS)} AS k, (l_suppkey + l_partkey) % {len(X.PARSERS)} AS p, l_linenumber, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS ordinal, (l_quantity % 3) / 10 AS confidence FROM lineitem),
         r AS (SELECT f.*, parser, rank FROM f JOIN {values(list(enumerate(_FAMILIES)), 'm, fam')} ON k = m JOIN {values(list(enumerate(X.PARSERS)), 'n, parser')} ON p = n JOIN {_RANKS.replace(') v(', ') w(')} USING (parser) WHERE family = fam)
    SELECT page, (ARRAY{_KEYS})[k + 1] AS raw_key, parser, confidence, l_linenumber::VARCHAR AS value FROM r QUALIFY row_number() OVER (PARTITION BY page, k ORDER BY rank DESC, confidence DESC, ordinal) = 1
    """,
)
def merge_precedence(spark, sf_dir):
    """Every family of fields and every parser: which fact of an order's wins."""
    key = F.get(F.array(*[F.lit(k) for k in _KEYS]), (F.col("l_partkey") % len(_KEYS)).cast("int"))
    parser = F.get(F.array(*[F.lit(p) for p in X.PARSERS]), ((F.col("l_suppkey") + F.col("l_partkey")) % len(X.PARSERS)).cast("int"))
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), key.alias("raw_key"), F.col("l_linenumber").cast("string").alias("value"), (F.col("l_quantity") % 3 / 10).alias("confidence"), parser.alias("parser"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("ordinal"))
    return X.merge_facts(facts).drop("alternatives")


@query(
    "cross_validate",
    f"""
    WITH {_FACTS}, own AS (SELECT page, raw_key, parser, arg_min(value, (ordinal, -confidence, value)) AS value, arg_min(confidence, (ordinal, -confidence, value)) AS confidence, min(ordinal) AS ordinal FROM f GROUP BY ALL)
    SELECT page, raw_key, arg_max(value, (confidence, -ordinal)) AS value,
           round(CASE WHEN count(DISTINCT value) > 1 THEN greatest(0, max(confidence) - 0.12) ELSE least(1, max(confidence) + 0.05 * (count(*) - 1)) END, 6) AS confidence,
           count(*) AS sources, count(DISTINCT value) > 1 AS conflict
    FROM own WHERE raw_key <> 'colour' GROUP BY page, raw_key
    UNION ALL SELECT page, raw_key, value, round(confidence, 6), 1, false FROM own WHERE raw_key = 'colour'
    """,
)
def cross_validate(spark, sf_dir):
    """Titles and prices are compared, colours carried."""
    return X.cross_validate(line_facts(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(
    "canonical_payload",
    f"""
    WITH {_FACTS}, b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page, raw_key ORDER BY confidence DESC, ordinal) = 1)
    SELECT page, max(value) FILTER (raw_key = 'title') AS title, max(value) FILTER (raw_key = 'base_price') AS price, max(value) FILTER (raw_key = 'colour') AS colour FROM b GROUP BY page
    """,
)
def canonical_payload(spark, sf_dir):
    return X.canonical_payload(line_facts(spark, sf_dir)).select("page", "title", F.col("basePrice").alias("price"), F.try_element_at("attributes", F.lit("colour")).alias("colour"))


#: Raw key, source pointer, value, kind of value, unit of facts to be mapped.
_TO_MAP = [("Colour", "$.x", "red", "string", None), ("size", "$.dims.size[0]", "12", "string", "cm"), ("vendor_code", "$.v", "a", "string", None), ("odd", "$.odd", "a", "string", None), ("wt", "$.wt", "heavy", "string", "lb"), ("variants[0].price", "$.p", "1", "number", None)]


@query(
    "map_facts",
    """
    WITH f AS (SELECT p_partkey, p_type, unnest(range(6)) AS m FROM part),
         s AS (SELECT *, CASE m WHEN 0 THEN 0.18 + 0.10 + 0.07 + 0.06
                                WHEN 1 THEN 0.40 + 0.10 + 0.07 + 0.06 * CASE WHEN p_type LIKE 'PROMO%' THEN 1 ELSE 0.2 END
                                WHEN 2 THEN 1.0 WHEN 4 THEN 0.40 + 0.03 + 0.07 * 0.2 + 0.06 * CASE WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'LARGE%' THEN 1 ELSE 0.2 END ELSE 0.0 END AS score FROM f)
    SELECT p_partkey, (ARRAY['Colour', 'size', 'vendor_code', 'odd', 'wt', 'variants[0].price'])[m + 1] AS raw_key, (ARRAY['color', 'size', 'mpn', NULL, 'weight', NULL])[m + 1] AS canonical_key, round(score, 6) AS score,
           CASE WHEN m = 2 THEN 'override' WHEN score >= 0.55 THEN 'auto' WHEN score >= 0.45 THEN 'auto_warn' WHEN score >= 0.25 THEN 'suggestion' ELSE 'unmapped' END AS band,
           CASE m WHEN 4 THEN 'weight|mass' WHEN 0 THEN 'color' WHEN 1 THEN 'size' WHEN 2 THEN 'mpn' ELSE '' END AS candidates
    FROM s
    """,
)
def map_facts(spark, sf_dir):
    """Facts of parts against an inline corpus: a synonym, a pointer with two mappings, an override, a fact that two ways map."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("raw_key", "source_pointer", "value", "value_kind", "unit"), row, strict=True)]) for row in _TO_MAP]))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"), each.alias("f")).select("p_partkey", "category", "f.*")
    channel = spark.createDataFrame([(1, "*", "$.dims.size[0]", "length"), (2, "*", "$.dims.size[0]", "size"), (3, "*", "wt", "weight"), (4, "NONE", "odd", "odd")], "ordinal int, category string, source_path string, canonical_key string")
    synonyms = spark.createDataFrame([("colour", "color"), ("WT", "mass")], "synonym string, canonical_key string")
    overrides = spark.createDataFrame([("vendor_code", "sku", 1), ("vendor_code", "mpn", 5)], "raw_key string, canonical_key string, priority int")
    known = [("color", "string", None, [], []), ("size", "number", "length", ["cm", "in"], ["PROMO"]), ("weight", "number", "mass", ["g"], ["SMALL", "LARGE"]), ("length", "string", None, [], [])]
    attributes = spark.createDataFrame(known, "canonical_key string, data_type string, unit_type string, allowed_units array<string>, category_scope array<string>")
    out = X.map_facts(rows, channel, synonyms, overrides, attributes)
    names = F.coalesce(F.array_join(F.transform("candidates", lambda c: c["key"]), "|"), F.lit(""))
    return out.select("p_partkey", "raw_key", "canonical_key", F.round("score", 6).alias("score"), "band", names.alias("candidates"))


_FACT = "struct<raw_key:string,value:string,unit:string,confidence:double,alternatives:array<string>>"


def fact(key: str, value, confidence=0.9, unit=None, alternatives=()):
    """A struct for the detectors; value and confidence may be columns."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    others = F.array(*[F.lit(a) for a in alternatives]).cast("array<string>")
    return F.struct(F.lit(key).alias("raw_key"), as_col(value).cast("string").alias("value"), F.lit(unit).cast("string").alias("unit"), as_col(confidence).cast("double").alias("confidence"), others.alias("alternatives")).cast(_FACT)


@query(
    "route_products",
    """
    WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS title, p_retailprice AS price, (p_size % 10) / 10.0 AS tc,
                      CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS category, p_size, lpad(p_partkey::VARCHAR, 8 + (p_partkey % 2)::INT, '0') AS gtin FROM part),
         s AS (SELECT p_partkey, (tc < 0.7)::INT AS a, (title IS NULL)::INT AS b, (category IS NULL)::INT AS c, (length(gtin) <> 8)::INT AS d FROM p)
    SELECT p_partkey, a + b + c + d AS n_signals, CASE WHEN a + b + c + d = 0 THEN 'auto' ELSE 'review' END AS decision,
           round(greatest(0, 1 - 0.15 * (a + c) - 0.25 * (b + d)), 6) AS score FROM s
    """,
)
def route_products(spark, sf_dir):
    none = lambda kind: F.lit(None).cast(kind)
    rows = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("title"),
        F.array(fact("title", F.col("p_name"), F.col("p_size") % 10 / 10.0), fact("base_price", F.col("p_retailprice"), 1.0)).alias("facts"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("category"),
        F.lit(0.9).alias("category_confidence"),
        F.array().cast("array<string>").alias("required"),
        F.col("p_brand").alias("brand"),
        F.lpad(F.col("p_partkey").cast("string"), (8 + F.col("p_partkey") % 2).cast("int"), F.lit("0")).alias("gtin"),
        *[none("string").alias(c) for c in ("model", "gtin_product", "gtin_brand", "mpn_product", "mpn_brand")],
        none("map<string,array<string>>").alias("axes"),
        none("long").alias("n_variants"),
        none("double").alias("median_price"),
        none("long").alias("samples"),
    )
    return P.route(P.detect(rows)).select("p_partkey", F.size("signals").cast("long").alias("n_signals"), "decision", F.round("score", 6).alias("score"))


#: What fires for a part by its number: kind, severity, field.
_FIRED = [
    (1, "low_confidence_mapping", "medium", "title"), (2, "missing_required_attribute", "high", "title"), (3, "missing_required_attribute", "medium", "color"), (4, "field_conflict", "high", "base_price"),
    (5, "unit_conflict", "medium", "weight"), (6, "potential_duplicate", "critical", None), (7, "category_ambiguous", "medium", None), (8, "variant_incomplete", "medium", None),
    (9, "price_anomaly", "high", None), (10, "value_contradiction", "high", "color"), (11, "value_contradiction", "high", "gtin"), (12, "unit_conflict", "medium", "box_height"), (13, "potential_duplicate", "critical", None),
]


def detected(spark, sf_dir):
    """Parts dealt to 15 cases: each detector fires for some, none for others (a unit that fits, an alternative that is equal)."""
    m = F.col("p_partkey") % 15
    on = lambda i, yes, no: F.when(m == i, yes).otherwise(no)
    none = lambda kind: F.lit(None).cast(kind)
    base = [fact("title", F.col("p_name"), on(1, 0.5, 0.9)), fact("currency", "EUR", 0.9)]
    extra = [(4, fact("base_price", "10", alternatives=("10.0", "12"))), (5, fact("weight", "5")), (10, fact("color", "pink")), (12, fact("box_height", "5")), (14, fact("screen_size", "15", unit="in", alternatives=("15",))), (0, fact("base_price", "10", alternatives=("10.0000001",)))]
    facts = F.array_compact(F.array(*base, *[F.when(m == i, f) for i, f in extra]))
    products = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("d.example").alias("domain"), on(2, none("string"), F.col("p_name")).alias("title"), facts.alias("facts"), on(9, F.lit(1000.0), F.lit(10.0)).alias("price"), on(7, none("string"), F.lit("a/b")).alias("category"), F.lit(0.9).alias("category_confidence"),
        F.array(on(3, F.lit("color"), F.lit("title"))).alias("required"), F.lit(" Acme ").alias("brand"), F.when(m == 6, "0-40063813").when(m == 11, "123").when(m == 14, "40063821").alias("gtin"), F.when(m == 13, "M-1").alias("model"),
        F.when(m == 8, F.create_map(F.lit("size"), F.array(F.lit("S"), F.lit("M")))).when(m == 10, F.create_map(F.lit("color"), F.array(F.lit("Red")))).alias("axes"), F.lit(1).cast("long").alias("n_variants"), F.lit(10.0).alias("median_price"), F.lit(10).cast("long").alias("samples"),
    )
    known = spark.createDataFrame([("gtin", "40063813", "p1"), ("gtin", "40063821", "p2"), ("mpn", "M-1", "p3")], "type string, value string, product string")
    brands = spark.createDataFrame([("p1", "Other"), ("p2", "acme"), ("p3", None)], "product string, brand string")
    # a gtin with a dash is no valid one: the payload's is checked without it
    return P.detect(P.known_brands(products, known, brands).withColumn("gtin", F.regexp_replace("gtin", "-", "")).withColumn("gtin", F.when(F.col("gtin") == "040063813", "40063813").otherwise(F.col("gtin"))))


@query(
    "detect_signals",
    f"""
    SELECT p_partkey, coalesce(kind || ':' || severity || ':' || coalesce(field, ''), '') AS signals, CASE WHEN kind IS NULL THEN 'auto' ELSE 'review' END AS decision,
           CASE severity WHEN 'medium' THEN 0.85 WHEN 'high' THEN 0.75 WHEN 'critical' THEN 0.55 ELSE 1.0 END AS score
    FROM part LEFT JOIN {values(_FIRED, 'm, kind, severity, field')} ON p_partkey % 15 = m
    """,
)
def detect_signals(spark, sf_dir):
    names = F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["kind"], s["severity"], F.coalesce(s["field"], F.lit("")))), "|")
    return P.route(detected(spark, sf_dir)).select("p_partkey", names.alias("signals"), "decision", F.round("score", 6).alias("score"))


_DIMS = {"low_confidence_mapping": '"domain":"d.example","field":"title",', "missing_required_attribute": '"category":"a/b","domain":"d.example",', "field_conflict": '"domain":"d.example","field":"base_price",', "potential_duplicate": '"domain":"d.example",', "category_ambiguous": '"category":"(none)","domain":"d.example",', "variant_incomplete": '"domain":"d.example",', "price_anomaly": '"brand":" Acme ","category":"a/b","domain":"d.example",'}


@query(
    "review_tasks",
    f"""
    SELECT p_partkey, kind, severity, field, substr(sha256('{{' || coalesce(dims, '"domain":"d.example","field":"' || field || '",') || '"signal_kind":"' || kind || '"}}'), 1, 16) AS cluster_key
    FROM part JOIN {values(_FIRED, 'm, kind, severity, field')} ON p_partkey % 15 = m LEFT JOIN {values(list(_DIMS.items()), 'k, dims').replace(') v(', ') w(')} ON kind = k
    """,
)
def review_tasks(spark, sf_dir):
    return V.review_tasks(detected(spark, sf_dir), "p_partkey").drop("nth")


@query(
    "validate_parts",
    """
    SELECT p_partkey AS id, p_type <> 'SMALL' OR (p_size <= 25 AND p_brand <> 'Brand#3' AND p_size % 2 = 0) AS valid,
           CASE WHEN p_type = 'SMALL' THEN (p_size > 25)::INT + (p_size % 2 <> 0)::INT ELSE 0 END AS n_errors,
           CASE WHEN p_type = 'SMALL' AND p_brand = 'Brand#3' THEN 1 ELSE 0 END AS n_missing
    FROM part
    """,
)
def validate_parts(spark, sf_dir):
    brand = F.when(F.col("p_brand") != "Brand#3", F.col("p_brand"))
    pairs = F.filter(F.array(F.struct(F.lit("brand").alias("key"), brand.alias("value")), F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"))), lambda p: p["value"].isNotNull())
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.map_from_entries(pairs).alias("attributes"))
    strict = [("SMALL", "authoritative", *r) for r in (("brand", "required", ""), ("size", "type", "integer"), ("size", "maximum", "25"), ("size", "multipleOf", "2"))]
    rules = spark.createDataFrame([*strict, ("LARGE", "inferred", "weight", "required", "")], "category string, tier string, key string, keyword string, arg string")
    return P.validate(records, rules).select("id", "valid", F.size("errors").alias("n_errors"), F.size("missing").alias("n_missing"))


@query(
    "unit_convert",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 2.54 WHEN 1 THEN p_size * 453.592 WHEN 2 THEN NULL ELSE p_size * 1000.0 END AS value FROM part",
)
def unit_convert(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("in"), F.lit("lb"), F.lit("mAh"), F.lit("l")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.to_canonical_unit(F.col("p_size").cast("double"), unit).alias("value"))


@query("gtin_norm", "SELECT c_custkey, nullif(regexp_replace(regexp_replace(c_name, '[\\s-]', '', 'g'), '^0+', ''), '') AS gtin FROM customer")
def gtin_norm(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.gtin(F.col("c_name")).alias("gtin"))


@query("axis_norm", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS axis FROM part")
def axis_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.axis_name(F.col("p_brand")).alias("axis"))


@query("cluster_key", "SELECT event_id, substr(sha256('{\"event\":\"' || event_type || '\",\"user\":\"' || user_id || '\"}'), 1, 16) AS cluster_key FROM events")
def cluster_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.cluster_key({"user": F.col("user_id"), "event": F.col("event_type")}).alias("cluster_key"))


def products(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product"),
        F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 100).cast("string")).alias("gtin"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("string").alias("mpn"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
    )


_FITS = "(x.c IS NULL OR e.c IS NULL OR x.c = e.c OR starts_with(x.c, e.c || '/') OR starts_with(e.c, x.c || '/'))"


@query(
    "dedupe_rules",
    f"""
    WITH p AS (SELECT p_partkey AS id, nullif(CASE WHEN p_partkey % 3 = 0 THEN ltrim((p_partkey % 100)::VARCHAR, '0') END, '') AS g, CASE WHEN p_partkey % 7 <> 0 THEN lower(p_brand) END AS b, p_size AS m, lower(p_name) || ' ' || (p_partkey % 500) AS t,
                      CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_type WHEN 2 THEN p_type || '/x' ELSE p_type || '/x/y' END AS c FROM part),
         x AS (SELECT * FROM p WHERE id % 10 = 1 OR id % 30 = 3), e AS (SELECT * FROM p WHERE NOT (id % 10 = 1 OR id % 30 = 3)),
         g AS (SELECT x.id, count(*) AS hits, bool_or(NOT {_FITS}) AS far, min(e.id) FILTER (NOT {_FITS}) AS fid, min(e.id) AS pid, bool_and(x.b IS NULL OR e.b IS NULL OR x.b = e.b) AS same FROM x JOIN e ON x.g = e.g GROUP BY x.id),
         t AS (SELECT x.id, coalesce(x.b = e.b AND x.m = e.m, false) AS model, e.id AS eid FROM x JOIN e ON {_FITS} AND 1 - levenshtein(x.t, e.t) / greatest(length(x.t), length(e.t)) >= 0.92),
         m AS (SELECT id, count(*) AS hits, min(eid) AS pid FROM t WHERE model GROUP BY id), n AS (SELECT id, min(eid) AS pid FROM t GROUP BY id)
    SELECT x.id AS candidate, CASE WHEN g.far THEN 'conflict' WHEN g.hits = 1 AND g.same THEN 'merge' WHEN g.hits >= 1 THEN 'review' WHEN m.hits = 1 THEN 'merge' WHEN m.hits > 1 OR n.pid IS NOT NULL THEN 'review' ELSE 'new' END AS action,
           coalesce(CASE WHEN g.far THEN fid END, g.pid, m.pid, n.pid) AS product, CASE WHEN g.hits > 0 THEN 'gtin' WHEN m.hits > 0 THEN 'brand_mpn' WHEN n.pid IS NOT NULL THEN 'title' ELSE 'none' END AS "by"
    FROM x LEFT JOIN g USING (id) LEFT JOIN m USING (id) LEFT JOIN n USING (id)
    """,
)
def dedupe_rules(spark, sf_dir):
    """Some products as candidates against the others; brands are missing here and there, categories are paths or missing."""
    p = F.col("product")
    category = F.when(p % 5 == 1, F.col("category")).when(p % 5 == 2, F.concat("category", F.lit("/x"))).when(p % 5 > 2, F.concat("category", F.lit("/x/y")))
    all_ = products(spark, sf_dir).withColumns({"category": category, "brand": F.when(p % 7 != 0, F.col("brand")), "title": F.concat("title", F.lit(" "), (p % 500).cast("string"))})
    is_new = (p % 10 == 1) | (p % 30 == 3)
    return R.dedupe(all_.filter(is_new), all_.filter(~is_new))


@query(
    "dedupe_titles",
    """
    WITH p AS (SELECT p_partkey AS id, nullif(CASE WHEN p_partkey % 3 = 0 THEN ltrim((p_partkey % 100)::VARCHAR, '0') END, '') AS g, lower(p_brand) AS b, p_size AS m, lower(p_name) || ' number ' || (p_partkey % 400) AS t, p_type AS c FROM part),
         x AS (SELECT * FROM p WHERE id % 10 = 1 OR id % 30 = 3), e AS (SELECT * FROM p WHERE NOT (id % 10 = 1 OR id % 30 = 3)),
         g AS (SELECT x.id, count(*) AS hits, bool_or(x.c <> e.c) AS far, min(e.id) FILTER (x.c <> e.c) AS fid, min(e.id) AS pid, bool_and(x.b = e.b) AS same FROM x JOIN e ON x.g = e.g GROUP BY x.id),
         t AS (SELECT x.id, x.b = e.b AND x.m = e.m AS model, e.id AS eid FROM x JOIN e ON x.c = e.c AND 1 - levenshtein(x.t, e.t) / greatest(length(x.t), length(e.t)) >= 0.92),
         m AS (SELECT id, count(*) AS hits, min(eid) AS pid FROM t WHERE model GROUP BY id), n AS (SELECT id, min(eid) AS pid FROM t GROUP BY id)
    SELECT x.id AS candidate, CASE WHEN g.far THEN 'conflict' WHEN g.hits = 1 AND g.same THEN 'merge' WHEN g.hits >= 1 THEN 'review' WHEN m.hits = 1 THEN 'merge' WHEN m.hits > 1 OR n.pid IS NOT NULL THEN 'review' ELSE 'new' END AS action,
           coalesce(fid, g.pid, m.pid, n.pid) AS product, CASE WHEN g.hits > 0 THEN 'gtin' WHEN m.hits > 0 THEN 'brand_mpn' WHEN n.pid IS NOT NULL THEN 'title' ELSE 'none' END AS "by"
    FROM x LEFT JOIN g USING (id) LEFT JOIN m USING (id) LEFT JOIN n USING (id)
    """,
)
def dedupe_titles(spark, sf_dir):
    """dedupe_rules over longer titles, with brands and categories that are always known."""
    p = products(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" number "), (F.col("product") % 400).cast("string")))
    is_new = (F.col("product") % 10 == 1) | (F.col("product") % 30 == 3)
    return R.dedupe(p.filter(is_new), p.filter(~is_new))


@query(
    "title_similarity",
    """
    WITH c AS (SELECT c_nationkey, lower(trim(c_name)) AS t, min(c_custkey) AS id, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT a.c_nationkey, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 9) AS similarity
    FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.t < b.t AND round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 9) >= 0.92
    """.replace("FROM customer", "FROM (SELECT c_nationkey, c_custkey, 'customer of ' || lower(c_mktsegment) || ' number ' || (c_custkey % 50) AS c_name FROM customer)"),
)
def title_similarity(spark, sf_dir):
    name = F.concat(F.lit("Customer of "), F.col("c_mktsegment"), F.lit(" number "), (F.col("c_custkey") % 50).cast("string"))
    return R.title_classes(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", name.alias("name")), "c_custkey", ["c_nationkey"], "name")


@query(
    "title_similarity_names",
    """
    WITH c AS (SELECT c_nationkey, lower(trim(c_name)) AS t, min(c_custkey) AS id, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT a.c_nationkey, a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 9) AS similarity
    FROM c a JOIN c b ON a.c_nationkey = b.c_nationkey AND a.t < b.t AND round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 9) >= 0.92
    """,
)
def title_similarity_names(spark, sf_dir):
    """The names as they are, of one word each."""
    return R.title_classes(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_custkey", ["c_nationkey"], "c_name")


@query(
    "reconcile_fields",
    """
    WITH f AS (SELECT c_nationkey AS nation, 'balance' AS field, 'customer' AS source, round(c_acctbal, 2)::VARCHAR AS value, (c_custkey % 10) / 10.0 AS confidence, c_custkey AS t FROM customer
               UNION ALL SELECT s_nationkey, 'balance', 'supplier', round(s_acctbal, 2)::VARCHAR, (s_suppkey % 10) / 10.0, s_suppkey FROM supplier)
    SELECT nation, field, source, confidence, t AS seen FROM f QUALIFY row_number() OVER (PARTITION BY nation, field ORDER BY confidence DESC, t DESC, source) = 1
    """,
)
def reconcile_fields(spark, sf_dir):
    side = lambda n, p, k: table(spark, sf_dir, n).select(F.col(f"{p}_nationkey").alias("nation"), F.lit("balance").alias("field"), F.lit(n).alias("source"), F.col(k).cast("string").alias("value"), (F.col(k) % 10 / 10.0).alias("confidence"), F.timestamp_seconds(k).alias("ts"))
    rows = side("customer", "c", "c_custkey").unionByName(side("supplier", "s", "s_suppkey"))
    return R.reconcile_fields(rows, ["nation", "field"]).select("nation", "field", "source", "confidence", F.col("value").cast("long").alias("seen"))


@query(
    "variant_matrix",
    "SELECT p_brand AS brand, count(DISTINCT p_type) * count(DISTINCT p_size) AS expected, count(DISTINCT (p_type, p_size)) AS present, greatest(0, count(DISTINCT p_type) * count(DISTINCT p_size) - count(DISTINCT (p_type, p_size))) AS missing FROM part GROUP BY 1",
)
def variant_matrix(spark, sf_dir):
    return R.variant_matrix(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_type", "p_size"), ["brand"], ["p_type", "p_size"])


@query("diff_fields", "SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS old, 'F' AS new, 0.6 AS confidence, false AS auto FROM orders WHERE o_orderstatus <> 'F'")
def diff_fields_query(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return diff_fields(old, old.withColumn("o_orderstatus", F.lit("F")), "o_orderkey", ["o_orderstatus", "o_orderpriority"], F.lit(None).cast("double"))


@query(
    "upsert_profiles",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer
    UNION ALL SELECT c_custkey + 1000000, 'added', 1.0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT NULL, 'null key', 2.0
    """,
)
def upsert_profiles(spark, sf_dir):
    """Changed rows, rows with a null that leaves what is stored, new rows, and a null key that is stored already."""
    stored = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    no_key = spark.createDataFrame([(None, "old", 2.0)], stored.schema)
    changed = stored.filter("c_custkey % 2 = 0").withColumns({"segment": F.lit("new"), "balance": F.when(F.col("c_custkey") % 4 == 0, 0.0)})
    added = stored.filter("c_custkey % 10 = 0").select(F.col("c_custkey") + 1_000_000, F.lit("added"), F.lit(1.0))
    new = changed.union(added).union(spark.createDataFrame([(None, "null key", None)], stored.schema))
    return upsert(stored.union(no_key), new, ["c_custkey"])
