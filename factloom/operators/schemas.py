"""Category schemas: JSON Schema documents read as rows, compiled to rules, and checked against nested records.

A schema becomes a table of rules (path, keyword, arg); a path is a pattern such as /sizes/*/width, where * is any item
of an array. Records are dealt by id and category, parsed, and taken apart into nodes (pointer, pattern, value), each level once and
as deep as the rules of its category go; nodes meet rules by equality of category and pattern. So a thousand schemas are a
thousand tables' worth of rows and one plan; of a record only its document is shuffled, once. Rules are broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.scalars import lookup
from factloom.sources.tables import dealt

# Keywords that say something about a value, and keywords that only describe.
KEYWORDS = [
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format",
    "minItems", "maxItems", "uniqueItems", "required", "additionalProperties", "minProperties", "maxProperties",
]
DESCRIBING = ["$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "tier", "confidence_required", "unit", "units"]
TIERS = ["authoritative", "inferred", "promoted_draft"]
TYPES = ["string", "number", "integer", "boolean", "array", "object", "null"]
#: Formats that can be checked, as patterns; dates have to be in the calendar besides.
_DAY, _TIME = r"\d{4}-\d{2}-\d{2}", r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(Z|[+-]([01]\d|2[0-3]):?[0-5]\d)"
FORMATS = {
    "date": f"^{_DAY}$",
    "time": f"^{_TIME}$",
    "date-time": f"^{_DAY}[Tt ]{_TIME}$",
    "email": r"^[^\s@]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?)+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
RULES = "category string, tier string, path string, keyword string, arg string"


def rules_of(schema: dict | bool, path: str = "") -> Iterator[tuple[str, str, str]]:
    """(path, keyword, arg as JSON) of a schema; what isn't known, or can't be checked as written, is an error."""
    if schema is True or schema == {}:
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path or '/'}: a schema has to be an object or true")
    for word, arg in schema.items():
        where = f"{path or '/'}: {word}"
        if word == "properties":
            for name, child in arg.items():
                yield from rules_of(child, f"{path}/{escaped(name)}")
        elif word == "items":
            yield from rules_of(arg, f"{path}/*")
        elif word == "allOf":
            for one in arg:
                yield from rules_of(one, path)
        elif word in KEYWORDS:
            kinds = arg if isinstance(arg, list) else [arg]
            if word == "type" and (unknown := [k for k in kinds if k not in TYPES]):
                raise ValueError(f"{where}: no such type: {unknown}")
            if word == "format" and arg not in FORMATS:
                raise ValueError(f"{where}: no such format: {arg}")
            if word == "additionalProperties":
                if not isinstance(arg, bool):
                    raise ValueError(f"{where}: only true and false can be checked")
                if arg:
                    continue
                arg = sorted(schema.get("properties", {}))
            if word in ("type", "enum", "required", "additionalProperties"):
                arg = arg if isinstance(arg, list) else [arg]
            elif word == "const":
                word, arg = "const", [arg]
            yield path, word, json.dumps(arg)
        elif word not in DESCRIBING:
            raise ValueError(f"{where}: unknown keyword")


def escaped(name: str) -> str:
    """A name as a part of a pointer."""
    return name.replace("~", "~0").replace("/", "~1")


def read_schemas(spark: SparkSession, folder: str, authoritative: list[str]) -> DataFrame:
    """category, version, document, required, optional, tier, display_name, active of the JSON files of a folder.

    A file is a schema and its name the category's path, __ standing for /. The tier is authoritative for the
    listed categories and inferred for others, whatever the file says. optional are the properties that aren't required.
    A file that isn't JSON has a null document, no keys and isn't active. `store.absent` appends those that aren't stored.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    category = F.regexp_replace(F.regexp_replace("file", r"\.json$", ""), "__", "/")
    doc = F.when(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.col("value"))
    none = F.array().cast("array<string>")
    required = F.coalesce(F.from_json(F.get_json_object(doc, "$.required"), "array<string>"), none)
    named = F.coalesce(F.json_object_keys(F.get_json_object(doc, "$.properties")), none)
    schemas = files.select(category.alias("category"), F.lit(1).alias("version"), doc.alias("document"), required.alias("required"), F.array_except(named, required).alias("optional"))
    tier = F.when(F.array_contains(F.lit(authoritative).cast("array<string>"), F.col("category")), "authoritative").otherwise("inferred")
    return schemas.select("*", tier.alias("tier"), F.element_at(F.split("category", "/"), -1).alias("display_name"), F.col("document").isNotNull().alias("active"))


def compile_schemas(schemas: DataFrame) -> DataFrame:
    """RULES of schemas (category, tier, document: JSON). A schema that can't be checked fails the job, with its category.

    A null document has no rules; a null tier is authoritative.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for category, tier, document in zip(batch["category"], batch["tier"], batch["document"], strict=True):
                try:
                    found = list(rules_of(json.loads(document))) if document is not None else []
                except ValueError as e:
                    raise ValueError(f"schema of {category}: {e}") from e
                out += [(category, tier or TIERS[0], *r) for r in found]
            yield pd.DataFrame(out, columns=["category", "tier", "path", "keyword", "arg"])

    return schemas.select("category", "tier", "document").mapInPandas(run, RULES)


def kind_of(v: Column) -> Column:
    """The JSON type of a variant; integers are numbers."""
    kinds = {"OBJ": "object", "ARR": "array", "STR": "string", "BOO": "boolean", "VOI": "null"}
    return F.when(v.isNotNull(), F.coalesce(lookup(kinds, F.substring(F.schema_of_variant(v), 1, 3)), F.lit("number")))


def plain(v: Column, kind: Column | None = None) -> Column:
    """Text that is equal for equal JSON values: numbers by value, objects whatever the order of their keys."""
    kind = kind_of(v) if kind is None else kind
    return F.when(kind == "number", F.concat(F.lit("#"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(F.to_json(v))


def keys_of(v: Column) -> Column:
    """Names of an object's members; null for other kinds."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def with_args(rules: DataFrame) -> DataFrame:
    """category, pattern, keyword of rules, and their args as tests need them: read once a rule, not once a node."""
    word, arg = F.col("keyword"), F.col("arg")
    one = F.get_json_object(F.concat(F.lit('{"a":'), arg, F.lit("}")), "$.a")  # the string that arg is
    values = F.transform(F.try_variant_get(F.try_parse_json(arg), "$", "array<variant>"), lambda v: plain(v))
    return rules.select(
        "category",
        F.col("path").alias("pattern"),
        "keyword",
        arg.try_cast("double").alias("least"),
        F.when(word.isin("type", "required", "additionalProperties"), F.from_json(arg, "array<string>")).alias("listed"),
        F.when(word.isin("enum", "const"), values).alias("values"),
        F.when(word.isin("pattern", "format"), one).alias("one"),
        (arg == "true").alias("on"),
    )


def broken() -> Column:
    """Whether a node (kind, value) breaks a rule (`with_args`); keywords hold for values of a kind that they aren't about."""
    kind, value, word, least, listed, values, one = map(F.col, ("kind", "value", "keyword", "least", "listed", "values", "one"))
    number = F.when(kind == "number", F.try_variant_get(value, "$", "double"))
    text = F.when(kind == "string", F.try_variant_get(value, "$", "string"))
    items = F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>"))
    keys = F.when(kind == "object", keys_of(value))
    typed = F.array_contains(listed, kind) | (F.array_contains(listed, F.lit("integer")) & F.coalesce(number == F.floor(number), F.lit(False)))
    shaped = F.coalesce(*[F.when(one == name, F.rlike(text, F.lit(shape))) for name, shape in FORMATS.items()])
    dated = F.when(one.isin("date", "date-time"), F.substring(text, 1, 10).try_cast("date").isNotNull()).otherwise(True)
    tests = {
        "type": ~typed,
        "enum": ~F.array_contains(values, plain(value, kind)),
        "const": ~F.array_contains(values, plain(value, kind)),
        "minimum": number < least,
        "maximum": number > least,
        "exclusiveMinimum": number <= least,
        "exclusiveMaximum": number >= least,
        "multipleOf": number / least != F.floor(number / least),
        "minLength": F.char_length(text) < least,
        "maxLength": F.char_length(text) > least,
        "pattern": ~F.rlike(text, one),
        "format": ~(shaped & dated),
        "minItems": items.isNotNull() & (F.size(items) < least),
        "maxItems": items.isNotNull() & (F.size(items) > least),
        "uniqueItems": F.col("on") & (F.size(F.array_distinct(F.transform(items, lambda v: plain(v)))) < F.size(items)),
        "required": F.size(F.array_except(listed, keys)) > 0,
        "additionalProperties": F.size(F.array_except(keys, listed)) > 0,
        "minProperties": F.size(keys) < least,
        "maxProperties": F.size(keys) > least,
    }
    out = F
    for name in KEYWORDS:
        out = out.when(word == name, tests[name])
    return F.coalesce(out, F.lit(False))


def known_paths(rules: DataFrame) -> DataFrame:
    """category, known, more: paths that a rule is about or below, and whether a rule is about something below."""
    steps = F.split("path", "/")
    upper = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat_ws("/", F.slice(steps, F.lit(1), n)))
    each = rules.select("category", "path", F.explode(upper).alias("known"))
    return each.groupBy("category", "known").agg(F.bool_or(F.col("known") != F.col("path")).alias("more"))


def with_children(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Nodes (id, category, bad, pointer, pattern, kind, value, fresh), and members or items of fresh ones that rules are about
    something below; these are fresh now. Fresh nodes that no rule is about or below go."""
    nodes = nodes.withColumn("known", F.when(F.col("fresh"), F.col("pattern"))).join(F.broadcast(known), ["category", "known"], "left")
    nodes = nodes.filter("more is not null or not fresh")
    entry = "array<struct<key:string,value:variant>>"
    members = F.map_entries(F.try_variant_get("value", "$", "map<string,variant>")).cast(entry)
    items = F.try_variant_get("value", "$", "array<variant>")
    items = F.arrays_zip(F.slice(F.sequence(F.lit(0), F.size(items)), F.lit(1), F.size(items)).cast("array<string>"), items).cast(entry)
    itself = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("value")))
    below = F.when(F.col("more"), F.coalesce(F.when(F.col("kind") == "object", members), F.when(F.col("kind") == "array", items)))
    each = nodes.select("id", "category", "bad", "pointer", "pattern", "kind", F.explode(F.concat(itself, F.coalesce(below, F.array().cast(entry)))).alias("e"))
    key, value, old = F.col("e.key"), F.col("e.value"), F.col("e.key").isNull()
    part = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    at = lambda name, of: F.when(old, F.col(name)).otherwise(F.concat(F.col(name), F.lit("/"), of)).alias(name)
    kind = F.when(old, F.col("kind")).otherwise(kind_of(value))
    return each.select("id", "category", "bad", at("pointer", part), at("pattern", F.when(F.col("kind") == "array", "*").otherwise(part)), kind.alias("kind"), value.alias("value"), (~old).alias("fresh"))


def check_records(records: DataFrame, rules: DataFrame) -> DataFrame:
    """id, valid, missing, errors (path, keyword), tier for each row of records (id, category, document: JSON text).

    Every rule is tried at every place it is about. missing are the names of required members that aren't there, of nested
    objects too; errors are in order of path and keyword, a path is the place's pointer, / for the whole. A category
    without a schema has no errors and a null tier. A document that isn't JSON, or null, has the error json. Ids tell
    records apart; rows of one id and category are one record. Values aren't coerced: "5" is no number.
    """
    deepest = rules.agg(F.max(F.size(F.split("path", "/")) - 1)).head()[0] or 0  # rules are as many as schemas have lines
    rows = dealt(records.select("id", "category", "document"), "id", "category")
    rows = rows.select("id", "category", F.try_parse_json("document").alias("value"))
    # each row twice: what stands for the record, which no rule meets, and the node of the whole
    rows = rows.select("id", "category", "value", F.explode(F.array(F.lit(None).cast("string"), F.lit(""))).alias("pattern"))
    whole = F.col("pattern").isNotNull()
    nodes = rows.filter(~whole | F.col("value").isNotNull()).select(
        "id", "category", F.when(~whole, F.col("value").isNull()).alias("bad"), F.col("pattern").alias("pointer"), "pattern", F.when(whole, kind_of(F.col("value"))).alias("kind"), F.when(whole, F.col("value")).alias("value"), whole.alias("fresh")
    )
    known = known_paths(rules)
    for _ in range(deepest):
        nodes = with_children(nodes, known)
    wrong = nodes.join(F.broadcast(with_args(rules)), ["category", "pattern"], "left").filter(F.col("bad").isNotNull() | broken())
    path = F.when(F.col("pointer") == "", "/").otherwise(F.col("pointer")).alias("path")
    absent = F.when(F.col("keyword") == "required", F.array_except("listed", keys_of(F.col("value"))))
    wrong = wrong.select("id", "category", "bad", path, "keyword", absent.alias("absent"))
    found = wrong.groupBy("id", "category").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform("absent", lambda n: F.struct(n.alias("name"), F.col("path")))))).alias("missing"),
        F.array_sort(F.collect_set(F.when(F.col("keyword") != "required", F.struct("path", "keyword")))).alias("errors"),
        F.bool_or("bad").alias("bad"),
        F.bool_or(~F.col("bad")).alias("good"),
    )
    bad = F.array(F.struct(F.lit("/").alias("path"), F.lit("json").alias("keyword")))
    found = found.withColumn("missing", F.transform(F.array_sort("missing"), lambda m: m["name"]))
    found = found.withColumn("errors", F.explode(F.array_compact(F.array(F.when(F.col("good"), F.col("errors")), F.when(F.col("bad"), bad)))))
    out = found.join(F.broadcast(rules.groupBy("category").agg(F.min("tier").alias("tier"))), "category", "left")
    return out.select("id", "category", ((F.size("missing") == 0) & (F.size("errors") == 0)).alias("valid"), "missing", "errors", "tier")
