"""How work grows with its input: pairs that don't arise, tasks that stay small."""

from factloom.operators import categories as C
from factloom.operators import resolve as R
from factloom.plans.catalog import QUERIES
from factloom.sources import record_pages as D


def test_dedupe_makes_no_pairs_of_a_model(spark):
    """Titles of one brand and mpn, or of one gtin, aren't compared row by row; what is found stays the same."""
    schema = "product long, gtin string, brand string, mpn string, title string, category string"
    known = [(i, "77" if i < 3 else None, "Acme" if i else " ", "m", f"a lamp with a shade of paper {i:03}", ("home", "home/lamp", None)[i % 3]) for i in range(300)]
    known.append((900, "88", "", None, None, "toys"))
    new = [(1000, None, "ACME ", "M", "A lamp with a shade of paper 010", "home/lamp"), (1001, None, "acme", "m", "A lamp with a shade of cloth 999", "home"), (1002, "77", "acme", "m", "?", "home"), (1003, "88", "b", None, "?", "toys"), (1004, "88", "b", None, "?", None), (1005, "88", "b", None, "?", "food"), (1006, None, "other", "m", "a lamp with a shade of paper 299", "toys"), (1007, "99", "acme", "m", None, "home")]
    got = R.dedupe(spark.createDataFrame(new, schema), spark.createDataFrame(known, schema))
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line and "levenshtein" in line]
    assert all("(key#" in line for line in joins), joins
    rows = {r.candidate: (r.action, r.product, r.by) for r in got.collect()}
    assert rows == {1000: ("review", 1, "brand_mpn"), 1001: ("new", None, "none"), 1002: ("review", 0, "gtin"), 1003: ("merge", 900, "gtin"), 1004: ("merge", 900, "gtin"), 1005: ("conflict", 900, "gtin"), 1006: ("review", 29, "title"), 1007: ("new", None, "none")}


def test_many_pages_are_few_tasks(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = spark.range(1000).selectExpr("if(id % 2 = 0, 'a', 'b') AS connection", "lpad(id, 5, '0') AS updated_at", "string(id) AS external_id", """concat('{"id":', id, ',"updated_at":"', lpad(id, 5, '0'), '"}') AS raw""")
    D.write_pages(rows, path, size=2)
    got = D.drain(spark, path)
    assert got.rdd.getNumPartitions() <= D.TASKS < len(D.listed(path)) == 500
    assert sorted(map(tuple, got.select("external_id", "connection", "page", "updated_at").collect())) == sorted((str(i), "ab"[i % 2], i // 4, f"{i:05}") for i in range(1000))
    assert len(D.bundled([None] * 150_000)) == 1500


def held_before_shuffles(df):
    """Aggregates and sorts of the plan that come before any exchange, where they hold all of what a task reads."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    out = []
    for i, line in enumerate(plan):
        if "Aggregate(" in line or "Sort [" in line or "SortAggregate" in line:
            below = []
            for x in plan[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            if not any("Exchange" in x for x in below):
                out.append(line.strip(" :+-"))
    return out


def test_rows_are_dealt_before_they_are_held(spark, sf_dir):
    """Groups of hardly more than a row aren't collected by the tasks that read them."""
    for name in ("identities", "rehydrate"):
        assert held_before_shuffles(QUERIES[name](spark, sf_dir)) == [], name


def test_equal_contents_are_asked_once(spark, tmp_path):
    """Rows of the index meet titles, types and tags, not products."""
    rows = spark.range(500).selectExpr("id", "'a lamp' AS title", "if(id % 2 = 0, 'lamp', null) AS type", "array('home') AS tags")
    paths = spark.createDataFrame([(0, "home/lamp")], "ordinal long, path string")
    got = C.detect_categories(rows, paths)
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x and "_key" in x]
    assert joins and all("Join Inner" in x for x in joins)
    assert sorted((r.id, r.path, r.confidence) for r in got.collect()) == [(i, "home/lamp", 0.65 if i % 2 else 0.85) for i in range(500)]


def test_decisions_are_dealt_by_all_tasks(spark, sf_dir):
    """Decisions, tasks and diffs aren't held by the tasks that read them, nor broadcast; a task has its share of them."""
    df = QUERIES["decide"](spark, sf_dir)
    assert [x for x in held_before_shuffles(df) if "bloom_filter_agg" not in x] == []  # a filter has a fixed size
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.count("REPARTITION_BY_NUM") > 5


def test_prices_are_dealt_before_they_are_counted(spark, sf_dir):
    """Prices of parts aren't counted by the tasks that read them, and parts aren't broadcast."""
    for name in ("price_clusters", "price_anomaly"):
        df = QUERIES[name](spark, sf_dir)
        assert held_before_shuffles(df) == [], name
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString(), name
