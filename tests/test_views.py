"""Views kept up by changes: late and withdrawn rows, replays, runs that die."""

import datetime
import random
import shutil

import pytest
from pyspark.sql import functions as F

from factloom.operators import views as W

T = datetime.datetime(2024, 1, 1)
AS_OF = "2024-01-03 00:00:00"


def made(n):
    rng = random.Random(n)
    pick = lambda *x: rng.choice(x)
    return [
        (i, pick("t", "u", None), pick("c", "d"), T + datetime.timedelta(minutes=rng.randrange(2880)), pick(0.0, 0.1, 0.7, None), pick("{}", '{"a":1}', None), pick("x", "", None), pick(True, False, None), pick(0.1, 0.2, None), pick(3, 7, None), float(pick(5, 9, 12)))
        for i in range(n)
    ]


SCHEMA = "id int, tenant string, category string, created_at timestamp_ntz, confidence double, attributes string, title string, success boolean, cost double, tokens int, price double"
VIEWS = {
    "fleet_overview": lambda: W.fleet_overview(2), "domain_health": lambda: W.domain_health(1), "field_completeness": lambda: W.field_completeness(["title", "confidence"], 1),
    "parser_versions": lambda: W.parser_versions(2), "cost_panel": lambda: W.cost_panel(2), "price_clusters": lambda: W.price_clusters(["tenant", "category"], 5),
}


def source(df):
    """Rows with the names that all views read."""
    same = {"ts": "created_at", "domain": "tenant", "parser": "category", "extractor": "tenant", "mapper": "category", "policy": "title", "prompt_tokens": "tokens", "completion_tokens": "tokens"}
    return df.withColumns({k: F.col(v) for k, v in same.items()})


@pytest.mark.parametrize("name", VIEWS)
def test_increments_equal_a_recompute(spark, tmp_path, name):
    view = VIEWS[name]()
    rows = made(400)
    df = lambda some: source(spark.createDataFrame(some, SCHEMA))
    folder = str(tmp_path / "view")
    came = [rows[:150], rows[150:300], rows[300:]]
    gone = [[], rows[20:60], rows[140:200]]
    for i, (new, old) in enumerate(zip(came, gone, strict=True)):
        at = str(tmp_path / f"delta{i}")
        df(new).withColumn("change", F.lit(1)).unionByName(df(old).withColumn("change", F.lit(-1))).write.parquet(at)
        assert W.refresh(view, folder, spark.read.parquet(at), i)
        assert not W.refresh(view, folder, spark.read.parquet(at), i)  # again
        shutil.rmtree(at)  # nothing of it is read later
    left = [r for i, r in enumerate(rows) if not (20 <= i < 60 or 140 <= i < 200)]
    W.rebuild(view, str(tmp_path / "whole"), df(left), 0)
    got, want = (sorted(map(tuple, W.shown(view, spark, f, AS_OF).collect()), key=str) for f in (folder, str(tmp_path / "whole")))
    assert got == want and got


def test_a_run_that_died_does_not_count(spark, tmp_path):
    view, folder = W.parser_versions(2), str(tmp_path / "v")
    with pytest.raises(ValueError, match="not been built"):
        W.shown(view, spark, folder, AS_OF)
    rows = source(spark.createDataFrame(made(30), SCHEMA)).withColumn("change", F.lit(1))
    W.refresh(view, folder, rows, 1)
    before = sorted(W.shown(view, spark, folder, AS_OF).collect(), key=str)
    (tmp_path / "v" / "batch=2").mkdir()
    (tmp_path / "v" / "batch=2" / "part-0.parquet").write_bytes(b"half")
    assert sorted(W.shown(view, spark, folder, AS_OF).collect(), key=str) == before
    assert W.refresh(view, folder, rows, 2) and W.refresh(view, folder, rows.limit(0), 3)
    assert sum(r.n for r in W.shown(view, spark, folder, AS_OF).collect()) == 60
    assert {p.name for p in (tmp_path / "v").iterdir()} == {"batch=2", "batch=3"}
