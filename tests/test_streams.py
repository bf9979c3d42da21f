"""Streams with state: in order of time, over restarts, and equal to their batch twins."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.streaming import events as E

T = datetime.datetime(2024, 1, 1, 10)
at = lambda m: T + datetime.timedelta(minutes=m)


def run(spark, tmp_path, make, schema, batches, out="out"):
    """Each batch is a run of its own, that goes on from the checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / out))
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / out))


def flights(rows, minutes=15):
    held, out = {}, {}
    for key, ts in sorted(rows, key=lambda r: r[1]):
        free = key not in held or ts - held[key] >= datetime.timedelta(minutes=minutes)
        held[key] = ts if free else held[key]
        out[key, ts] = free
    return out


def test_single_flight_over_restarts(spark, tmp_path):
    batches = [[("a", at(5)), ("a", at(0)), ("b", at(1)), ("a", at(15))], [("a", at(31)), ("b", at(40)), ("a", at(29))], [("b", at(41)), ("c", at(500))]]
    got = {(r.key, r.ts): r.admitted for r in run(spark, tmp_path, E.single_flight, "key string, ts timestamp", batches).collect()}
    want = flights([r for b in batches for r in b])
    assert {k: v for k, v in want.items() if k[0] != "c"} == got


def states(rows):
    out, now = {}, {}
    for c, ts, to in sorted(rows, key=lambda r: r[1:]):
        state, bad = now.get(c, ("pending", 0))
        now[c] = (to, bad) if to in E.TRANSITIONS.get(state, []) else (state, bad + 1)
        out[c, ts, to] = now[c]
    return out


def test_connections_over_restarts(spark, tmp_path):
    batches = [[("a", at(3), "revoked"), ("a", at(1), "active"), ("b", at(2), "deleted")], [("a", at(4), "active"), ("b", at(5), "pending_failed")], [("a", at(6), "deleted"), ("z", at(900), "active")]]
    done = run(spark, tmp_path, E.connection_states, "connection string, ts timestamp, to string", batches)
    got = {(r.connection, r.ts): (r.state, r.rejected) for r in done.collect()}
    assert got == {k[:2]: v for k, v in states([r for b in batches for r in b]).items() if k[0] != "z"}
    assert got["a", at(6)] == ("deleted", 1) and got["b", at(5)] == ("pending_failed", 1)


def test_share_jumps_on_a_stream(spark, tmp_path):
    """A window's sum and the state after it, in one stream, equal the same on a table."""
    rows = [(at(60 * h + m), d, "llm" if (h + m) % k == 0 and h % 3 == 2 else "rules") for d, k in (("x", 1), ("y", 2), ("z", 9)) for h in range(9) for m in range(0, 60, 7)]
    batches = [sorted(rows)[i * 60 : i * 60 + 60] for i in range(5)] + [[(at(60 * 200), "w", "rules")]]
    schema = "ts timestamp, domain string, rung string"
    got = sorted(tuple(r) for r in run(spark, tmp_path, E.jumps, schema, batches).collect())
    want = sorted(tuple(r) for r in E.jumps(spark.createDataFrame(rows, schema)).collect())
    assert got == want and {r[1] for r in got} == {"x", "y"} and len(got) == 6


@pytest.mark.parametrize("n", [1, 4])
def test_tables_as_streams(spark, n):
    rows = [(f"k{i % 3}", at(i * 7 % 200)) for i in range(60)]
    got = {(r.key, r.ts): r.admitted for r in E.single_flight(spark.createDataFrame(rows, "key string, ts timestamp").repartition(n)).collect()}
    assert got == flights(dict.fromkeys(rows))
