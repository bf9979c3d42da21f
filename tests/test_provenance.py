"""Provenance on bucketed tables, missing variants, and small rules."""

import itertools
import random

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import facts as X
from factloom.operators import provenance as O
from factloom.operators import resolve as R
from factloom.plans.chain_queries import chain_tables, provenance_chain
from factloom.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_of_one_diff(spark, sf_dir):
    tables = chain_tables(spark, sf_dir)
    try:
        O.save_bucketed(tables, "chain_test", 8)
        whole = sorted(provenance_chain(spark, sf_dir).collect(), key=str)
        assert sorted(O.provenance(spark, "chain_test").collect(), key=str) == whole
        one = whole[len(whole) // 2].diff
        assert sorted(O.provenance(spark, "chain_test", one).collect(), key=str) == [r for r in whole if r.diff == one]
        sums = O.fact_confidence(spark, "chain_test")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert "Exchange" not in plan(O.fact_confidence(spark, "chain_test")) and "SortMergeJoin" in plan(O.fact_confidence(spark, "chain_test"))
        assert {r.diff: r.facts for r in sums.collect()}[one] == sum(r.diff == one for r in whole)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS chain_test_{name}")


def test_missing_variants(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([*"abcd", None]), rng.choice([*range(5), None]), rng.choice([None, "x", "y"]) if g != "h" else None) for g in ["g", "h", None] for _ in range(14)]
    rows += [("one", "a", 1, "x"), ("none", None, None, None)]
    got = {}
    for r in R.missing_variants(spark.createDataFrame(rows, "g string, a string, b int, c string"), ["g"], ["a", "b", "c"], step=3).collect():
        got.setdefault(r.g, []).append((r.a, r.b, r.c))
    for g in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == g]
        axes = [sorted({r[i] for r in own} - {None}) or [None] for i in range(3)]
        every = list(itertools.product(*axes)) if any(x != [None] for x in axes) else []
        want = [c for c in every if c not in own][: max(0, len(every) - len(own))]
        assert sorted(got.get(g, []), key=str) == sorted(want, key=str), g
    wide = [("w", f"a{i}", f"b{i}", f"c{i}") for i in range(60)]
    assert R.missing_variants(spark.createDataFrame(wide, "g string, a string, b string, c string"), ["g"], ["a", "b", "c"]).count() == 60**3 - 60


def test_core_fallback_and_latest_schema(spark):
    rows = [("vendor", None, None, 0.85, False), ("price", None, "rules", 0.84, True), ("colour", None, None, 0.99, False), ("title", "name", None, 0.1, True)]
    facts = spark.createDataFrame(rows, "raw_key string, canonical_key string, method string, confidence double, approved boolean").withColumn("candidates", F.lit(None).cast("array<struct<key:string,score:double>>"))
    got = {r.raw_key: (r.canonical_key, r.method, r.approved, r.candidates and [tuple(c) for c in r.candidates]) for r in X.with_core_fallback(facts).collect()}
    assert got == {"vendor": ("brand", "core_field", True, [("brand", 0.95)]), "price": ("basePrice", "rules", False, [("basePrice", 0.95)]), "colour": (None, None, False, None), "title": ("name", None, True, None)}
    schemas = spark.createDataFrame([("a", 1, True), ("a", 3, False), ("a", 2, True), ("b", 1, None)], "category string, version int, active boolean")
    assert sorted((r.category, r.version) for r in store.latest_schemas(schemas).collect()) == [("a", 2), ("b", 1)]


def test_jitter(spark):
    rows = spark.range(200).select(F.col("id"), S.backoff_ms(F.lit(3), jitter=0.25, key=F.col("id")).alias("w"), S.backoff_ms(F.lit(20)).alias("m"), S.backoff_ms(F.lit(0)).alias("z")).collect()
    assert all(18_000 < r.w <= 24_000 for r in rows) and len({r.w for r in rows}) > 150 and rows[0].m == 600_000 and rows[0].z == 3000
