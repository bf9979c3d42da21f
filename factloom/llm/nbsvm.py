"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: of bytes, of words, and of words renamed by their first occurrence
in the n-gram (aab, abab), which any vocabulary shares. Log-count ratios of the two classes, from every
labelled training document, scale the indicators; a linear hinge-loss model on the scaled indicators is
fitted by dual coordinate descent to a sample of bounded size. The margin becomes a probability by a
logistic fit on the part of the sample that the descent has not seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written
from factloom.llm.words import U, blocks, flat_bytes, mix, prefix_hash, shingle_hash, slice_hash, word_bounds

BITS = 17
BUCKETS = 1 << BITS
#: Lengths of byte n-grams, word n-grams and n-grams of renamed words.
GRAMS, WORD_GRAMS, RENAMED = (3, 5), (1, 2), (2, 3, 4, 6, 8)
#: Labelled documents that the linear model is fitted to, at most: those of least hash. Ratios use all.
SAMPLE = 6000
#: Bytes of their bucket lists, at most: of long texts fewer are fitted to. A byte of text has so many n-grams at most.
FIT_BYTES, GRAMS_A_BYTE = 64 << 20, 6
COST, ROUNDS = 1.0, 12
#: Bytes of text whose n-grams are held at once.
BLOCK_BYTES = 1 << 20


def renamed(words: np.ndarray, size: int) -> np.ndarray:
    """For each n-gram of `size` words, a code of its words numbered by first occurrence."""
    n = len(words) - size + 1
    code = np.zeros(n, U)
    for i in range(1, size):
        first = np.full(n, i)
        for j in range(i - 1, -1, -1):
            first = np.where(words[j : j + n] == words[i : i + n], j, first)
        code = code * U(size) + first.astype(U)
    return code


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers of x, which is sorted in place."""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, one text after another in rising order, and the text of each."""
    data, starts = flat_bytes(texts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    begin, end, first = word_bounds(data, starts)
    words, owner = slice_hash(prefix_hash(data), begin, end), np.repeat(np.arange(len(starts) - 1), np.diff(first))
    found = []

    def add(keys: np.ndarray, of: np.ndarray, size: int, salt: int) -> None:
        n = len(keys)
        within = of[:n] == of[size - 1 : size - 1 + n]  # the space after a text may be in its last n-gram
        bucket = mix(keys[within] + U(salt)) >> U(64 - BITS)
        found.append(distinct((of[:n][within].astype(np.int64) << BITS) | bucket.astype(np.int64)))

    for size in GRAMS:
        if len(data) >= size:
            key = np.zeros(len(data) - size + 1, U)
            for i in range(size):
                key = (key << U(8)) | data[i : i + len(key)].astype(U)
            add(key * U(31), doc, size, size)
    for size in WORD_GRAMS:
        if len(words) >= size:
            add(shingle_hash(words, size), owner, size, 100 + size)
    for size in RENAMED:
        if len(words) >= size:
            add(mix(renamed(words, size)), owner, size, 200 + size)
    at = distinct(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return at & (BUCKETS - 1), at >> BITS


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (BUCKETS + 1, the last for a constant) of the hinge-loss model, by dual coordinate descent.

    Rows are bucket lists; a row's vector is ratio at its buckets over the square root of their number.
    Classes weigh alike in sum.
    """
    w, alpha = np.zeros(len(ratio) + 1), np.zeros(len(rows))
    roots = np.sqrt([len(r) + 1 for r in rows])
    norms = [float(ratio[r] @ ratio[r] + 1) / (len(r) + 1) for r in rows]
    share = {c: cost * len(y) / (2 * max(1, (y == c).sum())) for c in (-1, 1)}
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            values = ratio[rows[i]]  # made anew each time: the lists alone are held
            gradient = y[i] * (w[rows[i]] @ values + w[-1]) / roots[i] - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), share[int(y[i])])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i] / roots[i]
                w[rows[i]] += step * values
                w[-1] += step
                alpha[i] = new
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of class 1, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        s = p * (1 - p)
        h = np.array([[(s * margin**2).sum() + 0.01, (s * margin).sum()], [(s * margin).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 0.1)), float(np.clip(b, -20, 20))


def fit_sample(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray) -> dict:
    """Model of bucket lists and labels 0/1; of fewer than two classes, a constant."""
    if len(set(label.tolist())) < 2 or len(rows) < 20:
        prior = (label.sum() + 1) / (len(label) + 2)
        return {"w": np.zeros(BUCKETS), "bias": 0.0, "a": 0.0, "b": float(np.log(prior / (1 - prior))), "rows": len(rows)}
    y = np.where(label > 0, 1, -1)
    late = np.arange(len(rows)) % 5 == 4
    w = descend([r for r, s in zip(rows, late, strict=True) if not s], y[~late], ratio)
    margin = np.array([((w[:-1] * ratio)[r].sum() + w[-1]) / np.sqrt(len(r) + 1) for r in rows])
    held = late if len(set(label[late].tolist())) == 2 else ~late
    a, b = logistic(margin[held], label[held])
    return {"w": w[:-1] * ratio, "bias": float(w[-1]), "a": a, "b": b, "rows": len(rows)}


def train(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """The model of doc_id, text, label (0 or 1): ratios of all rows, weights of `sample` rows and FIT_BYTES at most."""
    n_bytes = F.col("n_bytes") if "n_bytes" in labelled.columns else F.octet_length("text")
    size = F.least(F.lit(BUCKETS), GRAMS_A_BYTE * F.coalesce(n_bytes, F.lit(0))) * 4
    total, bytes_ = labelled.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    share, most = min(1.0, 1.3 * sample / max(1, total), FIT_BYTES / max(1, bytes_)), FIT_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        names = ["bucket", "n0", "n1", "draw", "label", "buckets"]
        for batch in batches:
            for part in blocks(batch.select(["draw", "label", "text"]), limit=BLOCK_BYTES):
                bucket, doc = features(part.column(2))
                label = np.asarray(part.column(1)).astype(np.int64)
                draw = np.asarray(part.column(0))
                for c in (0, 1):
                    counts[c] += np.bincount(bucket[label[doc] == c], minlength=BUCKETS)
                firsts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                take = np.flatnonzero(draw < share)
                if len(take):
                    lists = [bucket[firsts[i] : firsts[i + 1]].astype(np.int32) for i in take]
                    none = pa.nulls(len(take), pa.int32())
                    yield pa.RecordBatch.from_arrays([none, pa.nulls(len(take), pa.int64()), pa.nulls(len(take), pa.int64()), pa.array(draw[take]), pa.array(label[take].astype(np.int32)), pa.array([x.tobytes() for x in lists], pa.binary())], names)
        some = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[0][some]), pa.array(counts[1][some]), pa.nulls(len(some), pa.float64()), pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], names)

    draw = (F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)).alias("draw")
    out = labelled.select(draw, F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "bucket int, n0 long, n1 long, draw double, label int, buckets binary")
    out = written(out, "nbsvm")
    counts = out.filter("bucket is not null").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # BUCKETS rows at most
    n = np.zeros((2, BUCKETS))
    n[0, counts["bucket"]], n[1, counts["bucket"]] = counts["n0"], counts["n1"]
    p = (n + 1) / (n + 1).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, label, held = [], [], 0
        for b in batches:
            for x, y in zip(b["buckets"], b["label"], strict=True):
                if held + len(x) <= most:
                    rows.append(np.frombuffer(x, np.int32))
                    label.append(y)
                held += len(x)
        yield pd.DataFrame({"model": [pickle.dumps(fit_sample(rows, np.array(label, np.int64), ratio))]})

    chosen = out.filter("buckets is not null").select("draw", "label", "buckets").orderBy("draw", "label", "buckets").limit(sample)
    return pickle.loads(chosen.select("label", "buckets").coalesce(1).mapInPandas(fit, "model binary").head()[0])


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """docs with a column `name`: the probability of label 1; of null and empty texts too."""
    docs = docs.drop(name)
    w, bias, a, b = (model[k] for k in ("w", "bias", "a", "b"))
    w = w.astype(np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=BLOCK_BYTES):
                bucket, doc = features(part.column(part.schema.get_field_index("text")))
                k = np.bincount(doc, minlength=part.num_rows)
                margin = (np.bincount(doc, w[bucket], minlength=part.num_rows) + bias) / np.sqrt(k + 1)
                out = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes, label of the documents that labels mark and that aren't held out; n_bytes (of text) is there
    before the join, so that sums of it need no texts.

    Labels other than 0 and 1, null ones and ids take no part, nor do ids that labels mark both ways.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).filter("label = most")
    return docs.filter("doc_id is not null").filter(~held_out(F.col("doc_id"))).select("doc_id", "text", F.octet_length("text").alias("n_bytes")).join(marks.select("doc_id", "label").hint("merge"), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """docs' columns with score (0 to 1), predicted (1 if score >= threshold) and held_out.

    Only text is an input of the score. Null and empty texts are scored as having no n-gram; rows of a
    null doc_id are scored but never trained on. Without labels of both classes every score is the prior.
    Repeated rows are scored alike. Columns of docs with the names of the new ones are replaced.
    """
    docs = docs.drop("score", "predicted", "held_out")
    model = train(training_rows(docs, labels), sample)
    scored = score(docs, model)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
