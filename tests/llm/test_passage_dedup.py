import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import passage_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length):
    """(n_words, n_removed, sha256 of what is left) of each doc_id, window by window."""
    first, words, out = {}, {i: WORD.findall(t or "") for i, t in rows if i is not None}, {}
    for i in sorted(words):
        for p in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][p : p + length]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.removed_spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect()}


def made(n, seed, length):
    """Texts of few words, with passages, copies and edited copies of each other."""
    rng = random.Random(seed)
    passage = [" ".join(rng.choices("abcdefgh", k=length + rng.randint(-2, 3))) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.4 and texts:
            words = rng.choice(texts).split()
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice("xyz")
            texts.append("\t".join(words))
        else:
            parts = [" ".join(rng.choices("abcdefghij", k=rng.randint(1, 60))), rng.choice(passage), " ".join(rng.choices("klmno", k=rng.randint(1, 40))), rng.choice(passage)]
            texts.append("  ".join(parts[rng.randint(0, 1) :]))
    ids = list(range(n))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("period", sorted(passage_dedup.COVERS))
def test_covers(period):
    members = passage_dedup.COVERS[period]
    assert {(a - b) % period for a in members for b in members} == set(range(period))


@pytest.mark.parametrize("length", [8, 20, 50])
@pytest.mark.parametrize("most", [16, 0])
def test_passages_match_brute_force(spark, monkeypatch, length, most):
    monkeypatch.setattr(passage_dedup, "MOST", most)
    rows = made(250, length + most, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = result(passage_dedup.remove_passages(docs, length))
    assert got == plain(rows, length) and sum(x[1] for x in got.values()) > 1000


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passage_dedup.op13_passage_dedup(spark, sf_dir).collect()}
    assert got == plain([tuple(r) for r in docs.collect()], 50)


def test_very_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(600_000)]
    part = words[262_000:262_400]  # over a border of pieces
    rows = [(1, " ".join(words)), (2, " ".join(["new", *part, "end"])), (3, " ".join(["x"] * 40 + words[100:300_000])), (0, " ".join(["y", *words[400_000:400_060]]))]
    got = result(passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows, 50) and got[2][1] == 400 and got[1][1] == 60


def test_edges(spark, edge_docs, no_docs):
    docs = edge_docs.withColumns({c: F.lit("x") for c in ("runs", "ours", "rest", "start", "digest", "least")})
    done = passage_dedup.remove_passages(docs, 10)
    assert sorted(done.columns) == sorted(dict.fromkeys([*docs.columns, "n_words", "removed_spans", "kept_text"]))
    rows = done.collect()
    assert len(rows) == docs.count() and all(r.runs == "x" and r.rest == "x" for r in rows)
    want = plain([(r.doc_id, r.text) for r in edge_docs.collect()], 10)
    got = result(done.filter("doc_id is not null"))
    assert got == want and got[2][1] == 15 and got[10][1] > 0
    assert all(r.removed_spans == [] for r in rows if r.doc_id in (None, 11))
    assert passage_dedup.remove_passages(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h i"), (2, "a b c d e f g h i")], "doc_id long, text string")
    assert sorted(len(r.removed_spans) for r in passage_dedup.remove_passages(twice, 8).collect()) == [0, 0, 1]
    with pytest.raises(ValueError, match="8 words"):
        passage_dedup.remove_passages(no_docs, 5)
