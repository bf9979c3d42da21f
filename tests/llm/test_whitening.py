import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import whitening


def plain(rows, most=8):
    """vec_id, deviation, whitened, explained by numpy, in exact numbers up to the covariance."""
    used = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in used]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True)) for row in x]
    off = np.array([[c - t / n for c, t in zip(row, s, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    by = np.argsort(-values)[:most]
    white = off @ vectors[:, by] / np.sqrt(values[by])
    return [i for i, _ in used], n, deviation, white, values[by] / (sum(deviation) / n**3)


def test_whitening_is_that_of_numpy(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids, n, deviation, white, explained = plain([(r.vec_id, r.embedding) for r in table.collect()])
    got = whitening.op12_whitening(spark, sf_dir).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 9))
    rows = {(r.vec_id, r.component): r for r in got}
    assert [rows[i, 1].deviation for i in ids] == deviation
    w = np.array([[rows[i, k].whitened for k in range(1, 9)] for i in ids])
    np.testing.assert_allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-8)
    np.testing.assert_allclose([rows[ids[0], k].explained for k in range(1, 9)], explained, rtol=1e-9)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(8)).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error <= 1e-4 and error <= 1e-4
    assert abs(error - got[0].identity_error) < 1e-9


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), "x", 1) for i in range(20)]
    rows += [(0, rows[0][1], None, 2), (None, rows[1][1], "x", 3), (50, None, "x", 4), (51, [], None, 5), (52, [1.0, None, 2.0], "x", 6)]
    rows += [(53, [1.0, float("nan"), 2.0], "x", 7), (54, [float("inf"), 1.0, 2.0], "x", 8), (55, [1.0, 2.0], "x", 9), (56, [1e300, 1.0, 2.0], "x", 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, deviation long")
    got = whitening.whiten(table).collect()
    _, n, deviation, white, explained = plain([(r[0], r[1]) for r in rows[:22]])
    assert n == len(got) == 22 and sorted(int(r.deviation) for r in got) == sorted(deviation)
    assert sum(r.vec_id is None for r in got) == 1 and sum(r.vec_id == 0 for r in got) == 2
    by = {(r.vec_id, r.label): r for r in got}
    w = np.array([by[r[0], r[2]].whitened for r in rows[:22]])
    assert w.shape == (22, 3)
    np.testing.assert_allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-9)
    np.testing.assert_allclose(got[0].explained, explained, rtol=1e-9)
    assert set(got[0].asDict()) == {"vec_id", "label", "n", "deviation", "whitened", "explained", "identity_error"}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(r.whitened == [] and r.identity_error == 0 and r.deviation == 0 for r in got)
    assert len(got) == sum(r[1] is not None for r in rows)


def test_few_directions(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 5.0]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-9 for r in got) and got[0].identity_error < 1e-9


def test_deviations_beyond_64_bits(spark):
    rows = [(i, [float(i) * 1e9, -3.0]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=1).collect()
    _, _, deviation, _, _ = plain(rows)
    assert sorted(int(r.deviation) for r in got) == sorted(deviation) and max(deviation) > 2**63


def test_batches_of_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 7 == 3 else rng.normal(size=2).tolist()) for i in range(9500)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()
    ids, n, deviation, white, _ = plain(rows)
    by = {r.vec_id: r for r in got}
    assert [int(by[i].deviation) for i in ids] == deviation and len(got) == n
    w = np.array([by[i].whitened for i in ids])
    np.testing.assert_allclose(w * np.sign((w * white).sum(axis=0)), white, atol=1e-9)


def test_any_partitioning(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    one, many = ({r.vec_id: r for r in whitening.whiten(table.repartition(p, F.col("vec_id"))).collect()} for p in (1, 7))
    assert all(one[i].deviation == many[i].deviation and len(one[i].whitened) == 8 for i in one)
