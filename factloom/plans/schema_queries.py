"""Category schemas and category paths over the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from factloom.operators import categories as C
from factloom.operators import schemas as J
from factloom.plans.register import query
from factloom.sources.tables import table

#: A schema for each type of event; of errors none is stored.
_SCHEMAS = {
    "purchase": {"type": "object", "required": ["user", "value", "items"], "properties": {"value": {"type": "number", "minimum": 5, "exclusiveMaximum": 300}, "items": {"type": "array", "minItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 80}}}}}},
    "click": {"type": "object", "additionalProperties": False, "properties": {"user": {"type": "integer", "multipleOf": 3}, "value": {"type": "number"}, "day": {"type": "string", "format": "date", "pattern": "^2024-01-[01]"}, "items": {"type": "array", "maxItems": 3}, "props": {"type": "object", "properties": {"k": {"enum": [*range(0, 100, 2)]}}}}},
    "signup": {"required": ["email"], "properties": {"props": {"required": ["k", "source"], "properties": {"k": {"const": 7}}}}},
    "view": {"properties": {"items": {"uniqueItems": True}, "user": {"minimum": 8}, "day": {"minLength": 11}}},
}


@query(
    "schema_check",
    """
    WITH e AS (
      SELECT event_id AS id, event_type AS category, user_id, value, strftime(ts, '%Y-%m-%d') AS day, json_extract(props, '$.k')::INT AS k, event_id % 4 AS n FROM events),
    m AS (
      SELECT id, 'email' AS name FROM e WHERE category = 'signup'
      UNION ALL SELECT id, 'source' FROM e WHERE category = 'signup'
      UNION ALL SELECT id, 'k' FROM e WHERE category = 'signup' AND k IS NULL),
    w AS (
      SELECT id, '/value:minimum' AS error FROM e WHERE category = 'purchase' AND value < 5
      UNION ALL SELECT id, '/value:exclusiveMaximum' FROM e WHERE category = 'purchase' AND value >= 300
      UNION ALL SELECT id, '/items:minItems' FROM e WHERE category = 'purchase' AND n < 2
      UNION ALL SELECT id, '/items/' || i || '/k:maximum' FROM e, range(4) r(i) WHERE category = 'purchase' AND i < n AND k + i > 80
      UNION ALL SELECT id, '/user:multipleOf' FROM e WHERE category = 'click' AND user_id % 3 <> 0
      UNION ALL SELECT id, '/day:pattern' FROM e WHERE category = 'click' AND day NOT SIMILAR TO '2024-01-[01].*'
      UNION ALL SELECT id, '/props/k:enum' FROM e WHERE category = 'click' AND k % 2 = 1
      UNION ALL SELECT id, '/props/k:const' FROM e WHERE category = 'signup' AND k <> 7
      UNION ALL SELECT id, '/user:minimum' FROM e WHERE category = 'view' AND user_id < 8
      UNION ALL SELECT id, '/day:minLength' FROM e WHERE category = 'view'),
    ms AS (SELECT id, string_agg(name, '|' ORDER BY name) AS missing FROM m GROUP BY id),
    ws AS (SELECT id, string_agg(error, '|' ORDER BY error) AS errors FROM w GROUP BY id)
    SELECT e.id, ms.id IS NULL AND ws.id IS NULL AS valid, coalesce(missing, '') AS missing, coalesce(errors, '') AS errors,
           CASE category WHEN 'purchase' THEN 'authoritative' WHEN 'error' THEN NULL ELSE 'inferred' END AS tier
    FROM e LEFT JOIN ms USING (id) LEFT JOIN ws USING (id)
    """,
)
def schema_check(spark, sf_dir):
    """Events as nested documents (their props, a list of as many items as the id's remainder by 4) under their type's schema."""
    schemas = spark.createDataFrame([(k, "authoritative" if k == "purchase" else "inferred", json.dumps(v)) for k, v in _SCHEMAS.items()], "category string, tier string, document string")
    k = F.get_json_object("props", "$.k").cast("int")
    items = F.when(F.col("event_id") % 4 > 0, F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int") - 1), lambda i: F.struct((k + i).alias("k")))).otherwise(F.array().cast("array<struct<k:int>>"))
    document = F.to_json(F.struct(F.col("user_id").alias("user"), "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), items.alias("items"), F.struct(k.alias("k")).alias("props")))
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), document.alias("document"))
    checked = J.check_records(records, J.compile_schemas(schemas))
    errors = F.array_join(F.array_sort(F.transform("errors", lambda e: F.concat_ws(":", e["path"], e["keyword"]))), "|")
    return checked.select("id", "valid", F.array_join(F.array_sort("missing"), "|").alias("missing"), errors.alias("errors"), "tier")


_WORD = "split_part(p_name, ' ', 2)"


@query(
    "category_detect",
    f"""
    WITH paths AS (
      SELECT path, row_number() OVER (ORDER BY path) AS ordinal, string_split(path, '/') AS segs FROM (
        SELECT DISTINCT 'Shop/' || lower(p_type) || ' goods/' || {_WORD} || '/' || p_name AS path FROM part)),
    segments AS (SELECT ordinal, path, lower(segs[-1]) AS leaf, unnest(segs) AS raw, lower(raw) AS s FROM paths),
    products AS (
      SELECT p_partkey AS id,
        CASE p_partkey % 4 WHEN 0 THEN 'one ' || upper(p_name) || ', as new' WHEN 1 THEN 'a ' || {_WORD} || 's-set' WHEN 2 THEN 'all_' || lower(p_type) || '-goods!' END AS title,
        CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr({_WORD}, 1, 3) WHEN 2 THEN 'great_' || {_WORD} || 's' WHEN 3 THEN 'qx' WHEN 4 THEN '' END AS type,
        CASE p_partkey % 3 WHEN 0 THEN ['none', p_name] WHEN 1 THEN [lower(p_type) || '_GOODS', 'shop'] END AS tags FROM part),
    plain AS (
      SELECT id, regexp_replace(trim(lower(coalesce(title, ''))), '[-_]', ' ', 'g') AS title, regexp_replace(trim(lower(coalesce(type, ''))), '[-_]', ' ', 'g') AS type, tags FROM products),
    tag AS (SELECT id, unnest(range(len(tags))) AS pos, regexp_replace(lower(tags[pos + 1]), '[-_]', ' ', 'g') AS t FROM products),
    types AS (SELECT DISTINCT type FROM plain WHERE type <> ''), titles AS (SELECT DISTINCT title FROM plain WHERE title <> ''),
    r12 AS (
      SELECT type, min(ordinal) FILTER (leaf = type) AS r1, min(ordinal) FILTER (contains(s, type) OR contains(type, s)) AS r2 FROM types, segments GROUP BY type),
    r3 AS (
      SELECT title, min(ordinal) AS r3 FROM titles, segments WHERE len(s) >= 4 AND regexp_matches(title, '(^|[^a-z0-9_])' || s || '([^a-z0-9_]|$)') GROUP BY title),
    r4 AS (SELECT id, arg_min(o, pos) AS r4 FROM (SELECT id, pos, min(ordinal) AS o FROM tag JOIN segments ON t = s GROUP BY ALL) GROUP BY id),
    f AS (
      SELECT id, coalesce(r1, r2, r3, r4) AS o, CASE WHEN r1 > 0 THEN 0.85 WHEN r2 > 0 THEN 0.75 WHEN r3 > 0 THEN 0.65 WHEN r4 > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence
      FROM plain LEFT JOIN r12 USING (type) LEFT JOIN r3 USING (title) LEFT JOIN r4 USING (id))
    SELECT id, path, confidence FROM f LEFT JOIN paths ON o = ordinal
    """,
)
def category_detect(spark, sf_dir):
    """Parts whose titles, types and tags say more or less, against the paths of all kinds of parts."""
    part = table(spark, sf_dir, "part")
    word, kind, key = F.element_at(F.split("p_name", " "), 2), F.lower("p_type"), F.col("p_partkey")
    made = F.concat(F.lit("Shop/"), kind, F.lit(" goods/"), word, F.lit("/"), F.col("p_name"))
    paths = part.select(made.alias("path")).distinct().select("path", F.col("path").alias("ordinal"))
    title = F.when(key % 4 == 0, F.concat(F.lit("one "), F.upper("p_name"), F.lit(", as new"))).when(key % 4 == 1, F.concat(F.lit("a "), word, F.lit("s-set"))).when(key % 4 == 2, F.concat(F.lit("all_"), kind, F.lit("-goods!")))
    type_ = F.when(key % 7 == 0, F.upper("p_name")).when(key % 7 == 1, F.substring(word, 1, 3)).when(key % 7 == 2, F.concat(F.lit("great_"), word, F.lit("s"))).when(key % 7 == 3, "qx").when(key % 7 == 4, "")
    tags = F.when(key % 3 == 0, F.array(F.lit("none"), "p_name")).when(key % 3 == 1, F.array(F.concat(kind, F.lit("_GOODS")), F.lit("shop")))
    return C.detect_categories(part.select(key.alias("id"), title.alias("title"), type_.alias("type"), tags.alias("tags")), paths).select("id", "path", "confidence")
