import collections
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least_docs=3, top=200):
    """The whole result over rows of (text, lang, source), in Python's numbers, each pair over all terms."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: [t for t, n in docs[lang].items() if n >= least_docs] for _, lang, _ in rows}
    out = []

    def share(c, terms):
        total = sum(c[t] for t in terms)
        return {t: 1 + 10**9 * (c[t] + 1) // (total + len(terms)) for t in terms}

    p = {g: share(counts[g], kept[g[0]]) for g in {r[1:] for r in rows}}
    far = lambda a, b: (a - b) ** 2 // b
    for lang, source in p:
        whole = collections.Counter()
        for g in p:
            if g[0] == lang:
                whole.update(counts[g])
        q, mine = share(whole, kept[lang]), p[lang, source]
        pairs = [(sum(far(mine[t], p[g][t]) for t in kept[lang]), g[1]) for g in p if g[0] == lang and g[1] != source]
        terms = [(far(mine[t], q[t]), t) for t in kept[lang] if counts[lang, source][t] and mine[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit_is_that_of_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = result(source_audit.op11_source_audit(spark, sf_dir))
    assert got == plain([(r.text, r.lang, r.source) for r in docs.collect()])


@pytest.mark.parametrize("block", [1, 2])
def test_postings_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    rows = [(" ".join(f"w{chr(97 + i % 11)}{chr(97 + (i * j) % 13)}" for i in range(j, 60)), "en", f"s{j % 7}") for j in range(1, 30)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(source_audit.audit(docs)) == plain(rows)


def test_few_terms_at_the_top(spark):
    rows = [("a b c d e", "en", "x"), ("a b c d e e", "en", "x"), ("a b c d f", "en", "y"), ("a é É z", "en", "y"), ("a é f F", "en", None)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(source_audit.audit(docs, least_docs=2, top=2)) == plain(rows, 2, 2)


def test_edges(edge_docs, no_docs):
    docs = edge_docs.withColumn("rank", F.lit("x")).withColumn("p0", F.lit("x")).withColumn("term", F.lit(1)).withColumn("other", F.lit(None).cast("string"))
    got = result(source_audit.audit(docs))
    assert got == plain([(r.text, r.lang, r.source) for r in edge_docs.collect()])
    assert ("de", "b") not in {r[:2] for r in got}  # a lang of one group and no term
    assert source_audit.audit(no_docs).count() == 0
