"""Whitening of embeddings by their leading principal components.

Entries are put on an integer grid, so that counts, sums and deviations are exact whatever the partitioning. The
centred vectors become the distributed rows of MLlib's RowMatrix, whose singular value decomposition gives the
components; singular values are rescaled by the divisor n to standard deviations. The total variance isn't theirs:
it comes from the exact deviations of all rows, so the shares that components explain don't depend on how many are
computed. What is left of whitening's error is measured on the whitened rows themselves.

A task holds a block of vectors and one row of sums; the driver gets one number for each dimension and pair of
components, and MLlib's d * d products, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import deleted, table, written

COMPONENTS = 8
#: The grid: floor(GRID_SCALE * entry) + GRID_SHIFT.
GRID_SCALE, GRID_SHIFT = 1024, 100_000
#: Entries beyond it have no exact place on the grid and count as non-finite.
LARGEST = 2.0**40
#: Components of a smaller share of the total variance are noise of double precision.
LEAST_SHARE = 1e-10
#: Vectors handled at once in a task.
ROWS = 4096


def flat_entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all vectors as doubles (NaN where null), first entry and length of each (-1: a null vector)."""
    kind = pa.list_(pa.float64())
    vectors = vectors.cast(kind)
    offsets = np.asarray(vectors.offsets)
    length = np.where(np.asarray(vectors.is_null()), -1, np.diff(offsets))
    values = vectors.values.slice(offsets[0], offsets[-1] - offsets[0])  # a slice's values are those of the whole batch
    return values.to_numpy(zero_copy_only=False), offsets[:-1] - offsets[0], length


def on_grid(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the vectors that take part, and their entries on the grid."""
    values, first, length = flat_entries(vectors)
    some = np.flatnonzero(length == dims)
    x = values[first[some][:, None] + np.arange(dims)] if len(some) else np.zeros((0, dims))
    fine = (np.abs(x) <= LARGEST).all(axis=1)  # false for NaN
    return some[fine], np.floor(GRID_SCALE * x[fine]).astype(np.int64) + GRID_SHIFT


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def dimensions(vectors: DataFrame) -> int:
    """The most frequent length of usable vectors (embedding), the greater of equally frequent ones; 0: there are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values, first, length = flat_entries(part.column(0))
                bad = np.concatenate([[0], np.cumsum(~(np.abs(values) <= LARGEST))])
                some = np.flatnonzero(length > 0)
                some = some[bad[first[some] + length[some]] == bad[first[some]]]
                dims, n = np.unique(length[some], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int64)), pa.array(n)], ["dims", "n"])

    found = vectors.select("embedding").mapInArrow(run, "dims long, n long").groupBy("dims").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), F.desc("dims")).head()
    return top["dims"] if top else 0


def grid_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of usable vectors and the exact sums of their entries on the grid, one for each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dims, np.int64)
        for batch in batches:
            for part in slices(batch):
                some, x = on_grid(part.column(0), dims)
                n, sums = n + len(some), sums + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([n, *sums.tolist()], pa.int64())], ["dim", "s"])

    rows = vectors.select("embedding").mapInArrow(run, "dim int, s long").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["dim"]: int(r["s"]) for r in rows}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(dims)]


def gridded(vectors: DataFrame, dims: int, n: int, sums: list[int]) -> DataFrame:
    """The columns of vectors but embedding, with centred (array of doubles, x - S / n) and deviation (decimal, the sum
    of (n * x - S) ** 2) of each usable vector."""
    others = [c for c in vectors.columns if c != "embedding"]
    total, mean = np.array(sums, object), np.array([s / n for s in sums])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                some, x = on_grid(part.column(part.num_columns - 1), dims)
                most = n * int(np.abs(x).max(initial=0)) + int(np.abs(total).max())
                if dims * most**2 < 2**63 or most < 2**63 and dims * int(np.abs(n * x - total.astype(np.int64)).max(initial=0)) ** 2 < 2**63:
                    off = n * x - total.astype(np.int64)
                    deviation = (off * off).sum(axis=1).tolist()
                else:  # beyond 64 bits
                    deviation = [int(((n * row - total) ** 2).sum()) for row in x.astype(object)]
                centred = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), (x - mean).ravel())
                kept = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([*kept.columns[:-1], centred, pa.array(deviation, pa.decimal128(38, 0))], [*others, "centred", "deviation"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.select(*others).schema)
    return vectors.select(*others, "embedding").mapInArrow(run, f"{fields}centred array<double>, deviation decimal(38,0)")


def components(centred: DataFrame, n: int, dims: int, variance: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance (columns) and its eigenvalues, largest first, `most` at most.

    All components are asked for and few kept: up to 15,000 dimensions MLlib then decomposes the matrix of products with
    LAPACK, to double precision, where for few it iterates up to a tolerance.
    """
    rows = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("centred").alias("row")), "row")
    svd = RowMatrix(rows, numRows=n, numCols=dims).computeSVD(dims)
    values = np.array(svd.s.toArray()) ** 2 / n  # the divisor is n
    vectors = np.array(svd.V.toArray())[:, : len(values)]
    keep = np.flatnonzero(values > LEAST_SHARE * variance)[:most]
    vectors = vectors[:, keep]
    return vectors / np.linalg.norm(vectors, axis=0), values[keep]


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vectors' rows with n, deviation, whitened (array), explained (array) and identity_error; embedding goes.

    Rows take part whose embedding (array of numbers) isn't null or empty and has no null, NaN or infinite entry, none
    beyond LARGEST, and the length that most such rows have. The others have no result. Repeated rows count as often
    as they are there; a null vec_id is kept. All components that explain over LEAST_SHARE of the variance are there, up to
    `most`: equal vectors, or a single one, have none, and then both arrays are empty and the error is 0. An empty table
    gives an empty one. Other columns are kept, but for ones named like new ones.

    n: rows that take part. deviation: decimal, the exact sum over dimensions of (n * x - S) ** 2, x being the entry on
    the grid and S the dimension's sum. whitened: x - S / n projected on each component, over the component's standard
    deviation. explained: each component's share of the total variance. identity_error: the largest entry of the
    covariance of whitened minus the identity, of all rows together.
    """
    names = ["n", "deviation", "whitened", "explained", "identity_error"]
    vectors = vectors.drop(*names, "centred")
    others = [c for c in vectors.columns if c != "embedding"]
    dims = dimensions(vectors) or 1
    n, sums = grid_sums(vectors, dims)
    rows = written(gridded(vectors, dims, max(n, 1), sums), "gridded")
    spread = rows.agg(F.sum("deviation")).head()[0] or 0
    variance = float(spread) / max(n, 1) ** 3
    basis, values = components(rows, n, dims, variance, most) if spread else (np.zeros((dims, 0)), np.zeros(0))
    share = (values / variance).tolist() if spread else []
    scaled = basis / np.sqrt(values)
    k = len(values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, _, _ = flat_entries(part.column(len(others)))
                white = x.reshape(part.num_rows, -1) @ scaled if k else np.zeros((part.num_rows, 0))
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * k, white.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], part.column(len(others) + 1), lists], [*others, "deviation", "whitened"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*others).schema)
    white = written(rows.select(*others, "centred", "deviation").mapInArrow(run, f"{fields}deviation decimal(38,0), whitened array<double>"), "whitened")
    deleted(rows)
    off = [F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) - float(i == j) for i in range(k) for j in range(i, k)]
    error = float(np.abs([x for x in white.agg(*off).head()]).max()) if k else 0.0
    return white.select(*others, F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit(share).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")


QUERIES = {"op12_whitening": op12_whitening}
