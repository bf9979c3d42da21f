"""Append-only tables: insert what is absent, upserts, current versions, CSV evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def absent(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, one per key (the least of its rows, where they can be ordered), whose key isn't stored; nulls in keys are equal."""
    key = F.struct(*[F.col(c) for c in keys])
    rest = [c for c in new.columns if c not in keys]
    ordered = rest and not any("map<" in new.schema[c].dataType.simpleString() for c in rest)
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*new.columns) if ordered else new.dropDuplicates(keys)
    return one.withColumn("_key", key).join(stored.select(key.alias("_key")), "_key", "left_anti").drop("_key")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with those of new, a row per key, in place of the same key; nulls in keys are equal, and a null in a
    new row leaves what is stored."""
    same = None
    for k in keys:
        test = F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
        same = test if same is None else same & test
    both = stored.withColumn("_stored", F.lit(True)).alias("s").join(new.withColumn("_new", F.lit(True)).alias("n"), same, "full")
    key = lambda c: F.when(F.col("s._stored"), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*[key(c).alias(c) if c in keys else F.coalesce(f"n.{c}", f"s.{c}").alias(c) for c in stored.columns])


def approved_only(versions: DataFrame, diffs: DataFrame) -> DataFrame:
    """Versions whose diff is approved; others may not be appended."""
    return versions.join(diffs.filter(F.col("status").isin("approved", "auto_approved")).select("diff_id"), "diff_id", "left_semi")


def current(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest version of each key."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(key, "v.*")


def diff_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str], confidence: Column, least: float = 0.9) -> DataFrame:
    """key, field, old, new, confidence, auto: a row for each field that differs."""
    both = new.alias("n").join(old.alias("o"), key, "left")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields]))
    rows = both.select(F.col(key), F.coalesce(confidence, F.lit(0.6)).alias("confidence"), each.alias("d")).filter(~F.col("d.old").eqNullSafe(F.col("d.new")))
    return rows.select(key, "d.field", "d.old", "d.new", "confidence", (F.col("confidence") >= least).alias("auto"))


# Fields of a payload that reviewers see, in order.
PAYLOAD_FIELDS = ["title", "brand", "gtin", "modelNumber", "description", "basePrice", "currency", "canonicalCategory", "images", "attributes", "variants"]


def payload_diffs(payloads: DataFrame, facts: DataFrame, key: str, least: float = 0.9, fallback: float = 0.6) -> DataFrame:
    """key, field, value, confidence, auto: a row for each PAYLOAD_FIELDS that a payload has (null, or no such column: none).

    A field's confidence is the greatest of the facts (key, canonical_key, raw_key, confidence) whose canonical key, or raw
    key where there is none, is the field's name; `fallback` without one. Values are texts, nested ones JSON.
    """
    plain = {f.name: f.dataType.typeName() for f in payloads.schema}
    text = lambda n: F.to_json(F.col(n)) if plain[n] in ("array", "map", "struct") else F.col(n).cast("string")
    each = F.array(*[F.struct(F.lit(n).alias("field"), text(n).alias("value")) for n in PAYLOAD_FIELDS if n in plain])
    rows = payloads.select(key, F.explode(F.filter(each, lambda e: e["value"].isNotNull())).alias("e")).select(key, "e.*")
    best = facts.groupBy(key, F.coalesce("canonical_key", "raw_key").alias("field")).agg(F.max("confidence").alias("confidence"))
    confidence = F.coalesce("confidence", F.lit(fallback))
    return rows.join(best, [key, "field"], "left").select(key, "field", "value", confidence.alias("confidence"), (confidence >= least).alias("auto"))


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """Of each category the active schema of the greatest version."""
    return current(schemas.filter(F.coalesce("active", F.lit(True))), "category", ["version"])


def read_csv(spark: SparkSession, path: str, required: list[str], optional: list[str], most_bytes: int = 100 << 20, most_rows: int = 100_000) -> DataFrame:
    """Rows of headed CSV files with row (from 1, in each file), an attributes map of the columns named attributes.*, and errors.

    Headers are read from the first line, which must hold the required columns and no unknown ones. Files that are too
    large together, or have too many rows, are refused.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength() > most_bytes:
        raise ValueError(f"over {most_bytes} bytes")
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"missing columns: {missing}")
    if unknown := [c for c in header if c not in required + optional and not c.startswith("attributes.")]:
        raise ValueError(f"unknown columns: {unknown}")
    schema = StructType([StructField(c, StringType()) for c in [*header, "_corrupt"]])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    place = Window.partitionBy("_file").orderBy("_block", "_order")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_order"))
    rows = rows.withColumn("row", F.row_number().over(place)).persist()
    if rows.count() > most_rows:
        raise ValueError(f"over {most_rows} rows")
    extra = [c for c in header if c.startswith("attributes.")]
    pairs = F.filter(F.array(*[F.struct(F.lit(c.removeprefix("attributes.")).alias("key"), F.col(f"`{c}`").alias("value")) for c in extra]), lambda p: p["value"].isNotNull()) if extra else F.array().cast("array<struct<key:string,value:string>>")
    errors = F.array_compact(F.array(F.when(F.col("_corrupt").isNotNull(), F.lit("corrupt")), *[F.when(F.trim(F.col(f"`{c}`")).isNull() | (F.trim(F.col(f"`{c}`")) == ""), F.lit(f"{c} is empty")) for c in required]))
    return rows.select("row", *[F.col(f"`{c}`") for c in header if c not in extra], F.map_from_entries(pairs).alias("attributes"), errors.alias("errors"))
