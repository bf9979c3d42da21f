"""Paged sources: pages, drains, and streams that go on where they ended."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import record_pages as D


def records(spark, first, last, connection="shop a/b", per_second=3):
    rows = [(connection, f"2024-01-01T00:{i // per_second // 60:02}:{i // per_second % 60:02}Z", f"{i:04}", json.dumps({"id": f"{i:04}", "updated_at": f"2024-01-01T00:{i // per_second // 60:02}:{i // per_second % 60:02}Z", "n": i})) for i in range(first, last)]
    return spark.createDataFrame(rows, "connection string, updated_at string, external_id string, raw string")


def ids(df):
    return sorted(r.external_id for r in df.collect())


def test_pages_and_drains(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert D.drain(spark, path).count() == 0
    D.write_pages(records(spark, 0, 130).repartition(5), path)
    pages = D.listed(path)
    assert [(p.connection, p.number) for p in pages] == [("shop a/b", 0), ("shop a/b", 1), ("shop a/b", 2)] and pages[0].last == "2024-01-01T00:00:16Z"
    rows = D.drain(spark, path).collect()
    assert sorted(r.external_id for r in rows) == [f"{i:04}" for i in range(130)] and D.drain(spark, path).rdd.getNumPartitions() == 3
    assert all(r.page == int(r.external_id) // 50 and json.loads(r.raw)["n"] == int(r.external_id) for r in rows)
    assert ids(D.drain(spark, path, "2024-01-01T00:00:30Z")) == [f"{i:04}" for i in range(93, 130)]
    assert D.drain(spark, path, "2024-01-01T00:00:30Z").rdd.getNumPartitions() == 2  # the first page isn't opened


def test_broken_records(spark, tmp_path):
    rows = [("s", "2024", "1", "{broken"), ("s", "2025", "2", '{"id": 2}'), ("s", None, "3", "[1]")]
    D.write_pages(spark.createDataFrame(rows, "connection string, updated_at string, external_id string, raw string"), str(tmp_path / "p"))
    got = sorted(((r.raw, r.external_id, r.updated_at) for r in D.drain(spark, str(tmp_path / "p")).collect()), key=str)
    assert got == [("[1]", None, None), ('{"id": 2}', "2", None), ("{broken", None, None)]


def test_killed_runs_lose_and_repeat_nothing(spark, tmp_path):
    """A sink that dies in the midst of a batch, pages that come meanwhile, and equal times over a page's end."""
    path, out = str(tmp_path / "pages"), str(tmp_path / "out")
    died = []

    def start(sink):
        q = D.sync(spark, path).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        return q.foreachBatch(sink).start()

    def store(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    def die(df, batch):
        died.append(df.count())
        raise RuntimeError("killed")

    D.write_pages(records(spark, 0, 120), path)
    start(store).awaitTermination()
    D.write_pages(records(spark, 120, 180), path, first=F.lit(3))
    D.write_pages(records(spark, 0, 7, "other"), path)
    with pytest.raises(Exception, match="killed"):
        start(die).awaitTermination()
    D.write_pages(records(spark, 180, 190), path, first=F.lit(5))
    start(store).awaitTermination()
    start(store).awaitTermination()
    rows = [(r.connection, r.external_id) for r in spark.read.parquet(out).collect()]
    assert died == [67] and len(rows) == len(set(rows)) == 197
