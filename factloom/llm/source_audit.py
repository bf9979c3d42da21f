"""Divergence of sources: how the words of each source of a language differ from those of its other sources.

Every pair of sources starts at V times the divergence of two counts of zero, V being the language's number of terms;
an inverted index of the terms that do occur emits the corrections to that, so terms that neither source has
cost nothing. With f(g, s) the divergence of group g from group s at a term, p0 a group's share at a count of zero,

    sum f = V f(p0g, p0s) + [g has the term] (f(pg, p0s) - f(p0g, p0s)) + [s has it] (f(p0g, ps) - f(p0g, p0s))
                          + [both have it] (f(pg, ps) - f(pg, p0s) - f(p0g, ps) + f(p0g, p0s)).

The corrections of one side only depend on the count, so they are summed over a histogram of each group's counts.
Those of both sides come from the postings of a term: a task sums them for each pair of sources before it sends
them on. Postings of very many sources are dealt to blocks that meet pairwise, so that no task holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import deleted, partitions, table, written
from factloom.llm.words import blocks, flat_bytes, prefix_hash, slice_hash, word_bounds, word_ids

#: A language keeps the terms that so many of its documents have.
LEAST_DOCS = 3
SCALE = 1_000_000_000
#: Terms that are reported of each group.
TOP = 200
#: Parts that a group's terms are ranked in first.
SALTS = 64
#: Bytes of text whose terms are counted at once, and entries a task holds before it sends them on.
COUNTED_BYTES = 4 << 20
#: Sources in a block of a term's postings, and pairs of postings that are corrected at once.
BLOCK, PAIRS = 512, 1 << 20
#: A table of all groups is broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20

#: Bytes that are no part of a term: ASCII but letters. A-Z are lower-cased, and no other letter is.
GAP = np.ones(256, bool)
GAP[ord("A") : ord("Z") + 1] = False
GAP[ord("a") : ord("z") + 1] = False
GAP[128:] = False
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[GAP] = 32


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n, docs of docs (lang, source, text), summed over a few MB of texts each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", limit=COUNTED_BYTES, most=1 << 16):
                data, starts = flat_bytes(part.column(2))
                data = PLAIN[data]
                begin, end, first = word_bounds(data, starts)
                if not len(begin):
                    continue
                ids = word_ids(data, begin, end, slice_hash(prefix_hash(data), begin, end))
                most = int(ids.max()) + 1
                langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
                group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
                in_doc, at, n = np.unique(np.repeat(np.arange(len(first) - 1), np.diff(first)) * most + ids, return_index=True, return_counts=True)
                key, like, of = np.unique(group[in_doc // most] * most + in_doc % most, return_index=True, return_inverse=True)
                a, size, g = begin[at[like]], (end - begin)[at[like]], key // most
                upto = np.cumsum(size)
                raw = data[np.repeat(a - (upto - size), size) + np.arange(upto[-1])]
                term = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32)), pa.py_buffer(raw)])
                total = np.bincount(of, n).astype(np.int64)  # below 2 ** 53
                lang, source = langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary)))
                yield pa.RecordBatch.from_arrays([lang, source, term, pa.array(total), pa.array(np.bincount(of))], ["lang", "source", "term", "n", "docs"])

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact as long as total + terms is below 2.8e14; null for 0 / 0."""
    step, rest = 31_250, 32_000  # their product is SCALE
    below = F.nullif(total + terms, F.lit(0).cast("long"))
    a = (count + 1) * step
    high = div(a, below)
    return high * rest + div((a - high * below) * rest, below) + 1


def div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that aren't negative."""
    return F.call_function("div", a, b)


def far(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def corrections(postings: DataFrame) -> DataFrame:
    """lang, source, other, value: the corrections for terms that both have, of each ordered pair of different sources.

    postings: lang, term, sources (postings of the term), source, p, p0.
    """
    spark = postings.sparkSession
    n = F.ceil(F.col("sources") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("source"), n).cast("int")
    # block b meets every other block as the left one (side 1) and as the right one (2), and itself as both (0)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(j == block, F.array(place(block, j, 0))).otherwise(F.array(place(block, j, 1), place(j, block, 2))))
    cell = F.explode(F.flatten(cells))
    dealt = postings.filter("sources > 1").select("lang", "term", "source", "p", "p0", cell.alias("c")).select("lang", "term", "c.i", "c.j", "c.side", "source", "p", "p0")
    keys = ["lang", "term", "i", "j"]
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(t: pa.Table) -> pa.RecordBatch:
            term = np.concatenate([[0], np.cumsum(changes(t))])
            lang, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            side, p, p0 = (t.column(c).to_numpy() for c in ("side", "p", "p0"))
            l, s = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
            left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
            low, high = np.searchsorted(term[right], term[left], "left"), np.searchsorted(term[right], term[left], "right")
            upto, wide, at = np.cumsum(high - low), len(source.dictionary), 0
            keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            while at < len(left):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                many = (high - low)[at:to]
                a = np.repeat(left[at:to], many)
                b = right[np.repeat(low[at:to] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                a, b = a[s[a] != s[b]], b[s[a] != s[b]]
                value = (p[a] - p[b]) ** 2 // p[b] - (p[a] - p0[b]) ** 2 // p0[b] - (p0[a] - p[b]) ** 2 // p[b] + (p0[a] - p0[b]) ** 2 // p0[b]
                key, total = summed((l[a] * wide + s[a]) * wide + s[b], value)
                keys.append(key)
                values.append(total)
                at = to
            key, total = summed(np.concatenate(keys), np.concatenate(values))
            names = source.dictionary
            return pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // wide // wide)), names.take(pa.array(key // wide % wide)), names.take(pa.array(key % wide)), pa.array(total)], ["lang", "source", "other", "value"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows < 100_000:
                continue
            t = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(t))[-1]) + 1 if changes(t).any() else 0  # the last postings may go on
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys and the exact sum of each one's values."""
    key, of = np.unique(key, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, of, value)
    return key, total


def changes(t: pa.Table) -> np.ndarray:
    """Whether each row but the first has another lang, term, i or j than the one before."""
    out = np.zeros(max(0, t.num_rows - 1), bool)
    for name in ("lang", "term"):
        codes = t.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        out |= codes[1:] != codes[:-1]
    for name in ("i", "j"):
        c = t.column(name).to_numpy()
        out |= c[1:] != c[:-1]
    return out


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how each (lang, source) group of docs differs.

    Part `pair`: item is every other source of the lang, value its divergence, over all kept terms (0 without any).
    Part `term`: item is a kept term that the group has more of than the lang, value its divergence from the lang's share; the
    first `top` of them. Rank goes from 1, by value downwards and then by the bytes of item upwards.

    docs: text, lang, source; null is an empty string in each, and a group of its own name. Every row is a document, so repeated
    rows count repeatedly and doc_id isn't read; other columns aren't either. A group without terms has pairs, and no term.
    An empty table gives an empty one. Values of a pair are below 2 ** 63 for up to 2.8e14 terms in a lang.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(blank("lang"), blank("source"), blank("text"))
    counts = written(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.count("*").alias("sources"))
    kept = written(kept.filter(F.col("docs") >= least_docs), "terms")
    postings = counts.join(kept.select("lang", "term", "all", "sources").hint("merge"), ["lang", "term"])
    postings = written(postings.select("lang", "term", "source", "n", "all", "sources"), "postings")
    deleted(counts)
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")))
    groups = written(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    deleted(kept)
    bytes_ = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).head()[0] or 0
    near = F.broadcast(groups) if bytes_ <= BROADCAST_BYTES else groups
    shared = postings.join(near, ["lang", "source"])
    shared = shared.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))).withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("terms")))

    # terms: ranked in parts of a group first, so that no task gets a large group whole
    ranked = shared.filter("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), far(F.col("p"), F.col("q")).alias("value")).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    for keys in (["lang", "source", "salt"], ["lang", "source"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))
        ranked = ranked.withColumn("rank", rank).filter(F.col("rank") <= top)
    ranked = ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pairs: the base, corrections of one side by histograms of counts, corrections of both sides by postings
    histogram = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    met = histogram.join(F.broadcast(other) if bytes_ <= BROADCAST_BYTES else other, "lang").filter("source <> other")
    p, p0, o0, m = (F.col(c) for c in ("p", "p0", "o0", "m"))
    sums = written(met.groupBy("lang", "source", "other").agg(F.sum(m * (far(p, o0) - far(p0, o0))).alias("own"), F.sum(m * (far(o0, p) - far(o0, p0))).alias("others")), "one-sided")
    turned = sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("others").alias("value"))
    parts = sums.select("lang", "source", "other", F.col("own").alias("value")).unionByName(turned)
    parts = parts.unionByName(corrections(shared.select("lang", "term", "sources", "source", "p", "p0")))
    corrected = parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("more"))
    pairs = groups.join(F.broadcast(other) if bytes_ <= BROADCAST_BYTES else other, "lang").filter("source <> other")
    base = F.coalesce(F.col("terms") * far(p0, o0), F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", "other", base.alias("base")).join(corrected, ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("base") + F.coalesce("more", F.lit(0))).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(ranked)


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_audit": op11_source_audit}
ORACLES = {
    "op11_source_audit": f"""
    WITH docs AS (
      SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    words AS (
      SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= {LEAST_DOCS}),
    langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*) AS v FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
    shares AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
        1 + ({SCALE}::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
        LEFT JOIN counts c USING (lang, source, term)),
    found AS (
      SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares WHERE n > 0 AND p > q
      UNION ALL
      SELECT g.lang, g.source, 'pair', o.source, coalesce(s.value, 0)
      FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
        LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s
        ON s.lang = g.lang AND s.source = g.source AND s.other = o.source)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
    WHERE part = 'pair' OR rank <= {TOP}
    """
}
