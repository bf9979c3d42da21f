"""Batches in several tables, and scans in chunks, that die and go on."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import review as V
from factloom.sources import ledger as L


def both(spark, folder):
    return [sorted(map(tuple, L.committed(spark, folder, n).drop("batch").collect())) for n in ("artifacts", "jobs")]


SINKS = {"artifacts": lambda b: b.select("checksum", "body"), "jobs": lambda b: b.select("checksum", F.lit("extract").alias("job")).distinct()}
KEYS = {"artifacts": ["checksum"], "jobs": ["checksum"]}


def test_a_death_between_two_sinks(spark, tmp_path):
    """A stream that fans out to two tables, killed between them: after the replay both are as if nothing had been."""
    schema = "checksum string, body string"
    batches = [[("a", "1"), ("b", "2"), ("a", "1")], [("b", "2"), ("c", "3")], [("d", "4")]]
    tables = []
    for kill in (False, True):
        at = tmp_path / str(kill)
        folder = str(at / "out")

        def job_sink(b, state={"left": 2 if kill else 0}):
            if b.filter("checksum = 'c'").count() and state["left"]:
                state["left"] -= 1
                raise RuntimeError("killed")
            return SINKS["jobs"](b)

        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(at / "in"))
            for _ in range(3):
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
                q = stream.writeStream.option("checkpointLocation", str(at / "cp")).trigger(availableNow=True).foreachBatch(lambda df, n: L.write_batch(df, n, folder, {**SINKS, "jobs": job_sink}, KEYS)).start()
                try:
                    q.awaitTermination()
                    break
                except Exception as e:
                    assert "killed" in str(e)
                    # the first table has the batch's rows on disk, and no reader sees them
                    assert (at / "out" / "artifacts" / "batch=1").exists() and all(r[0] != "c" for r in both(spark, folder)[0])
        tables.append(both(spark, folder))
    assert tables[0] == tables[1] == [[("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], [(x, "extract") for x in "abcd"]]


def test_replays_and_empty_batches(spark, tmp_path):
    folder = str(tmp_path)
    assert L.committed(spark, folder, "artifacts") is None and L.committed(spark, folder, "artifacts", "checksum string").count() == 0
    batch = spark.createDataFrame([("a", "1")], "checksum string, body string")
    assert L.write_batch(batch, 0, folder, SINKS, KEYS) and not L.write_batch(batch, 0, folder, SINKS, KEYS)
    assert L.write_batch(batch.limit(0), 1, folder, SINKS, KEYS) and [len(x) for x in both(spark, folder)] == [1, 1]


def test_backfill_goes_on_after_any_chunk(spark, tmp_path):
    rows = [(i, {"k": "v"} if i % 3 == 0 else None, {"attributes": {"k": str(i)}, "evidence": {"by": "x"}} if i % 2 else None) for i in range(0, 400, 2)] + [(i, None, {"attributes": {"k": str(i)}, "evidence": None}) for i in range(1, 400, 4)]
    schema = "version long, attributes map<string,string>, extensions struct<attributes:map<string,string>,evidence:map<string,string>>"
    versions = spark.createDataFrame(rows, schema).withColumn("evidence", F.lit(None).cast("map<string,string>"))
    versions.repartitionByRange(6, "version").sortWithinPartitions("version").write.parquet(str(tmp_path / "v"))
    table = spark.read.parquet(str(tmp_path / "v"))
    make = lambda df: V.backfill(df)[0].select("version", F.to_json("attributes").alias("a"))
    want = sorted(map(tuple, make(table).collect()))
    for stop in (1, 4):
        folder = str(tmp_path / f"out{stop}")
        assert L.keyset_scan(table, "version", folder, make, 60, most=stop) == stop

        def die(df):
            make(df).write.mode("overwrite").parquet(f"{folder}/rows/batch={stop}")
            raise RuntimeError("killed")

        with pytest.raises(RuntimeError):
            L.keyset_scan(table, "version", folder, die, 60)
        assert L.keyset_scan(table, "version", folder, make, 60) == 5 - stop and L.keyset_scan(table, "version", folder, make, 60) == 0
        got = L.committed(spark, folder, "rows")
        assert sorted((r.version, r.a) for r in got.collect()) == want
        assert got.groupBy("batch").count().filter("count > 60").count() == 0
