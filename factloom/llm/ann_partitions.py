"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced partitions: partitions grow
over the graph from seeds, and then vectors move to the partition that most of their neighbours are in,
best gain first, while it has room. A small softmax classifier learns the partition from the vector and
files every vector of the table under its most probable partition.

A partition that holds too many vectors is cut again in the same way, on a sample of its own, and so on: the
number of partitions grows with the table, and their size doesn't. A query goes down the same classifiers,
along the most probable partitions at each level, and visits the most probable ones of the last; inner
products are computed there in double precision and the best are kept. How many partitions a query visits
is measured: for a bounded number of probes the whole table is searched by brute force, and the least number
is taken that finds enough, all of them if need be. So the work is in proportion to the table where vectors have a structure that
partitions can follow; of vectors spread evenly in many dimensions most partitions have to be visited.

Equal vectors are one candidate with its smallest ids, so a very common vector costs no more than others.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table, written

#: The sample that a partition is cut on: so many distinct vectors, about. The index holds every row.
SAMPLE = 6000
#: Vectors in a partition, about; a cut makes so many at most, and the first one so many at least.
CELL, MOST_PARTS, LEAST_PARTS = 1000, 60, 8
#: Distinct vectors below which nothing is cut, and levels of cuts.
LEAST, MOST_LEVELS = 200, 8
NEIGHBOURS = 10
#: Vectors that recall is measured on, partitions that their way down keeps at first, and the recall aimed at.
PROBES, BEAM, AIM = 256, 4096, 0.93
#: Vectors in a block of a partition and queries in a block, on average; a task compares block with block.
BLOCK, QUERY_BLOCK = 4096, 2048


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    near = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return near


def balanced_partition(near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A partition of the graph's vertices into `parts` of at most slack * mean vertices with few cut edges."""
    n, k = near.shape
    room = int(np.ceil(slack * n / parts))
    links = np.concatenate([np.stack([np.repeat(np.arange(n), k), near.ravel()]), np.stack([near.ravel(), np.repeat(np.arange(n), k)])], axis=1)
    rng = np.random.default_rng(7)
    part = np.full(n, -1)
    part[rng.choice(n, parts, replace=False)] = np.arange(parts)
    for r in range(rounds + 30):
        known = part[links[1]] >= 0
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (links[0][known], part[links[1][known]]), 1)
        growing = (part < 0).any()
        sizes = np.bincount(part[part >= 0], minlength=parts)
        own = np.where(part >= 0, votes[np.arange(n), np.maximum(part, 0)], 0)
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - own
        moves = np.flatnonzero((gain > 0) & (want != part) & ((part < 0) if growing else True))
        if not len(moves):
            break
        for v in moves[np.argsort(-gain[moves], kind="stable")]:
            if sizes[want[v]] < room and rng.random() < (1 if part[v] < 0 else 0.7):
                if part[v] >= 0:
                    sizes[part[v]] -= 1
                part[v] = want[v]
                sizes[want[v]] += 1
    for v in np.flatnonzero(part < 0):  # apart from all seeds, or what they reached was full
        sizes = np.bincount(part[part >= 0], minlength=parts)
        part[v] = sizes.argmin()
    return part


def fit_router(x: np.ndarray, part: np.ndarray, parts: int, near: np.ndarray, steps: int = 250) -> np.ndarray:
    """Softmax weights (dimensions + 1, parts); the aim of a vector is its neighbours' spread over partitions."""
    n = len(x)
    aim = np.zeros((n, parts))
    np.add.at(aim, (np.repeat(np.arange(n), near.shape[1]), part[near.ravel()]), 1.0)
    aim = 0.5 * aim / near.shape[1]
    aim[np.arange(n), part] += 0.5
    scale = np.sqrt((x**2).sum(axis=1).mean()) or 1.0
    f = np.hstack([x / scale, np.ones((n, 1))])
    w, m, v = np.zeros((f.shape[1], parts)), 0.0, 0.0
    for t in range(1, steps + 1):
        z = f @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = f.T @ (p - aim) / n + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[:-1] /= scale
    return w


def fit(x: np.ndarray, parts: int) -> np.ndarray:
    """The classifier's weights (dimensions + 1, parts), from a sample of distinct vectors."""
    parts = min(parts, len(x) // (2 * NEIGHBOURS))
    if parts < 2:
        return np.zeros((x.shape[1] + 1, 1))
    near = neighbour_graph(x, NEIGHBOURS)
    return fit_router(x, balanced_partition(near, parts), parts, near)


def chances(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log probabilities of the partitions, a row for each vector."""
    z = np.hstack([x, np.ones((len(x), 1))]) @ w
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id long, embedding array<double>, without the vectors that take no part."""
    values = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    return some.filter(~bad & F.exists("embedding", lambda v: v != 0)).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))


def down(rows: DataFrame, model: DataFrame, width: int) -> DataFrame:
    """rows (with dim, cell, chance, key, embedding) at the partitions of `model` go to their `width` most probable
    parts; those at other partitions stay. A task holds a block of the rows of a partition."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    at = rows.join(model.select("dim", "cell", "blocks"), ["dim", "cell"], "left")
    block = F.pmod(F.xxhash64("key", F.lit("down")), F.col("blocks")).cast("int")
    here = at.filter("blocks is not null").withColumn("block", block).drop("blocks")
    models = model.select("dim", "cell", "weights", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    names = rows.columns

    def route(b: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(b):
            return b[names]
        p = chances(pickle.loads(m["weights"].iloc[0]), np.stack(b["embedding"].to_list()))
        best = np.argsort(-p, axis=1, kind="stable")[:, :width]
        out = b.loc[b.index.repeat(best.shape[1])].reset_index(drop=True)
        out["chance"] += np.take_along_axis(p, best, axis=1).ravel()
        out["cell"] = out["cell"] * 64 + best.ravel() + 1
        return out[names]

    keys = ["dim", "cell", "block"]
    moved = here.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(route, fields)
    return moved.unionByName(at.filter("blocks is null").drop("blocks"))


def build(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """classes with dim and cell, their partition, and the models of each level (dim, cell, blocks, weights)."""
    filed, models, before = classes.withColumns({"cell": F.lit(0).cast("long"), "chance": F.lit(0.0)}), [], None
    for level in range(MOST_LEVELS):
        sizes = filed.groupBy("dim", "cell").agg(F.count("*").alias("n"))
        cut = F.col("n") > (2 * CELL if level else LEAST)
        if before is not None:  # a partition that its cut has left whole isn't cut again
            parent = before.select("dim", F.col("cell").alias("parent"), F.col("n").alias("was"))
            sizes = sizes.withColumn("parent", F.expr("(cell - 1) div 64")).join(parent, ["dim", "parent"], "left").drop("parent")
            cut = cut & (F.col("was").isNull() | (F.col("n") < 0.9 * F.col("was")))
        parts = F.greatest(F.lit(2 if level else LEAST_PARTS), F.least(F.lit(MOST_PARTS), F.expr(f"cast(n div {CELL} as int)")))
        sizes = written(sizes.select("dim", "cell", "n", cut.alias("cut"), parts.alias("parts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "cells")
        large = sizes.filter("cut").select("dim", "cell", "n", "parts", "blocks")
        if large.isEmpty():
            break
        draw = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
        sample = filed.join(large, ["dim", "cell"]).filter(draw * F.col("n") < SAMPLE).select("dim", "cell", "parts", "blocks", "key", "embedding")

        def train(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("key")
            row = b[["dim", "cell", "blocks"]].head(1).copy()
            row["weights"] = [pickle.dumps(fit(np.stack(b["embedding"].to_list()), int(b["parts"].iloc[0])))]
            return row

        models.append(written(sample.groupBy("dim", "cell").applyInPandas(train, "dim int, cell long, blocks int, weights binary"), "models"))
        filed, before = written(down(filed, models[-1], 1), "vector-index"), sizes
    return filed, models


def ranked(queries: DataFrame, models: list[DataFrame], beam: int) -> DataFrame:
    """queries (key, dim, embedding, query) with cell, once for each of the `beam` most probable partitions, and place, from 1."""
    queries = queries.withColumns({"cell": F.lit(0).cast("long"), "chance": F.lit(0.0)})
    place = F.row_number().over(Window.partitionBy("key", "query").orderBy(F.desc("chance"), "cell"))
    for model in models:
        queries = down(queries, model, min(beam, MOST_PARTS)).withColumn("place", place).filter(F.col("place") <= beam).drop("place")
        queries = written(queries, "vector-ways")
    return queries.withColumn("place", place)


def brute_force(filed: DataFrame, probes: list, k: int) -> DataFrame:
    """probe, cell of the k nearest classes of each probe, a row of key, dim, embedding; one scan."""
    dims = {d: [p for p in probes if p["dim"] == d] for d in {p["dim"] for p in probes}}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list] = {}
        for b in batches:
            for dim, rows in b.groupby("dim"):
                if dim not in dims:
                    continue
                x = np.stack(rows["embedding"].to_list())
                cells, keys = rows["cell"].to_numpy(), rows["key"].to_numpy()
                for p in dims[dim]:
                    s = x @ np.array(p["embedding"])
                    s[keys == p["key"]] = -np.inf
                    at = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                    kept = best.get(p["key"], []) + [(float(v), int(c)) for v, c in zip(s[at], cells[at], strict=True) if v > -np.inf]
                    best[p["key"]] = sorted(kept, reverse=True)[:k]
        rows = [(key, *r) for key, found in best.items() for r in found]
        yield pd.DataFrame(rows, columns=["key", "score", "cell"]).astype({"key": "int64", "score": "float64", "cell": "int64"})

    found = filed.select("dim", "key", "embedding", "cell").mapInPandas(run, "key long, score double, cell long")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "cell"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).select("key", "cell")


def visits(filed: DataFrame, models: list[DataFrame], k: int) -> int:
    """The least number of partitions in which probes find AIM of their nearest."""
    probes = filed.select("key", "dim", "embedding").orderBy(F.xxhash64("key", F.lit("probe")), "key").limit(PROBES).collect()
    asking = filed.sparkSession.createDataFrame(probes, "key long, dim int, embedding array<double>").withColumn("query", F.lit(0).cast("long"))
    there = written(brute_force(filed, probes, k), "vector-probes")
    total, cells, beam = there.count(), filed.select("dim", "cell").distinct().count(), BEAM
    while True:
        ways = ranked(asking, models, beam).select("key", "cell", "place")
        places = sorted(r["place"] for r in there.join(ways, ["key", "cell"]).select("place").collect())  # PROBES * k at most
        enough = max(1, math.ceil(AIM * total))
        if len(places) >= enough:
            return places[enough - 1]
        if beam >= cells:  # all partitions were on the way
            if total:
                raise RuntimeError(f"probes find {len(places)} of {total} nearest in all partitions")
            return 1
        beam *= 8


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, by largest inner product.

    vectors: vec_id, embedding. Queries are the rows whose vec_id is divisible by `every`; candidates are
    all rows but those of the query's own vec_id, of vectors of the same length. Ties go to the smaller vec_id.
    Rows whose vec_id is null, or whose vector is null, empty, zero or holds a null or non-finite number, take
    no part. Repeated rows (vec_id and vector) count once.
    """
    rows = written(clean_vectors(vectors).distinct().withColumn("key", F.xxhash64("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    # classes of equal vectors: the k + 1 smallest ids are all that can be in an answer
    small = Window.partitionBy("key", "embedding").orderBy("vec_id")
    firsts = rows.withColumn("nth", F.row_number().over(small)).filter(F.col("nth") <= k + 1).groupBy("key", "dim", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(F.col("vec_id") % every == 0)
    classes = written(firsts, "vector-classes")
    filed, models = build(classes)
    alike = asked.groupBy("key", "dim", "embedding").agg(F.min("vec_id").alias("query"))
    visit = visits(filed, models, k)
    # the way down keeps more than are visited, for the best parts of a partition that isn't among the first itself
    queries = written(ranked(alike, models, 2 * visit).filter(F.col("place") <= visit), "vector-queries")
    cell = ["dim", "cell"]
    sizes = filed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    q_sizes = queries.groupBy(*cell).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q_blocks"))
    sizes = written(sizes.join(q_sizes, cell), "vector-blocks")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = lambda n: F.pmod(F.xxhash64("key", F.lit("block")), F.col(n)).cast("int")
    left = queries.join(sizes, cell).select(*cell, home("q_blocks").alias("q_block"), F.explode(spread("blocks")).alias("block"), "key", "query", "embedding")
    right = filed.join(sizes, cell).select(*cell, F.explode(spread("q_blocks")).alias("q_block"), home("blocks").alias("block"), "key", "embedding", "ids")

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            c = c.assign(first=[i[0] for i in c["ids"]]).sort_values("first", kind="stable")
            b, ids = np.stack(c["embedding"].to_list()), c["ids"].to_list()
            best = min(k + 1, len(b))
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                x = np.stack(part["embedding"].to_list())
                s = x @ b.T
                least = np.partition(s, len(b) - best, axis=1)[:, len(b) - best]
                for i in range(len(x)):
                    hit = np.flatnonzero(s[i] >= least[i])
                    hit = hit[np.argsort(-s[i][hit], kind="stable")][:best]
                    out.append((part["key"].iloc[i], part["query"].iloc[i], [{"below": -float(np.dot(x[i], b[j])), "ids": ids[j]} for j in hit]))
        return pd.DataFrame(out, columns=["key", "query", "found"])

    keys = [*cell, "q_block", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "key long, query long, found array<struct<below:double,ids:array<long>>>")
    # k + 1 of each visited block: a bounded list for each query
    best = found.groupBy("key", "query").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    flat = best.select("key", "query", F.explode("found").alias("f")).select("key", "query", (-F.col("f.below")).alias("score"), F.explode("f.ids").alias("vec_id"))
    order = Window.partitionBy("key", "query").orderBy(F.desc("score"), "vec_id")
    best = flat.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    ids = asked.select(F.col("vec_id").alias("query_id"), "key", "embedding").join(alike, ["key", "embedding"]).select("query_id", "key", "query")
    answer = ids.join(best, ["key", "query"]).filter("query_id <> vec_id")
    # an id under two vectors is a candidate by its nearer one
    answer = answer.groupBy("query_id", "key", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_ann": op4_ann}
