"""Chains of near duplicates: components of any length."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import near_dup


def order(kind, n):
    if kind == "least last":
        return [*range(1, n), 0]
    if kind == "random":
        return random.Random(n).sample(range(n), n)
    bits = (n - 1).bit_length()
    return sorted(range(n), key=lambda i: int(format(i, f"0{bits}b")[::-1], 2))


@pytest.mark.parametrize("n", [300, 2000])
@pytest.mark.parametrize("kind", ["least last", "random", "bit-reversed"])
def test_chains_take_few_rounds(spark, monkeypatch, kind, n):
    written, names = near_dup.written, []
    monkeypatch.setattr(near_dup, "written", lambda df, name: names.append(name) or written(df, name))
    ids = order(kind, n)
    links = spark.createDataFrame([*zip(ids[:-1], ids[1:], strict=True), (5000, 5001), (5001, 5001)], "a long, b long")
    got = {r.doc_id: r.comp for r in near_dup.components(links).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 5000: 5000, 5001: 5000}
    rounds = names.count("edges") - 1
    assert rounds <= math.log2(n) + 1 and names.count("hooks") - rounds <= 2 * math.log2(n) + 4


def test_hubs_and_no_links(spark):
    links = spark.createDataFrame([(i, 900 + i % 2) for i in range(100)] + [(900, 1000), (1000, 901)], "a long, b long")
    assert {r.comp for r in near_dup.components(links).collect()} == {0}
    assert near_dup.components(links.limit(0)).count() == 0


def chain(n, ids, step=3, size=60):
    """Texts of which each shares over 85 % with the next, and none with others."""
    words = [f"w{i}" for i in range(size + step * n)]
    return [(ids[i], " ".join(words[step * i : step * i + size])) for i in range(n)]


def test_chain_of_texts(spark):
    ids = order("least last", 260)
    docs = spark.createDataFrame(chain(260, ids, step=2), "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(docs, 3, 85)
    assert got.filter((F.col("component_id") != 0) | (F.col("kept") != (F.col("doc_id") == 0))).count() == 0


def test_pipeline_stage_on_a_chain(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in chain(240, order("random", 240), step=2)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert [r.doc_id for r in kept] == [0]


def test_intermediate_tables_go(spark):
    import os

    where = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(where))
    docs = spark.createDataFrame(chain(20, range(20)), "doc_id long, text string")
    near_dup.near_duplicates(docs, 3, 85).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - before}
    assert left == {"signed", "classes", "labels"}
