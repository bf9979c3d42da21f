"""Mixing sources to target weights by Poisson replication.

Each document is repeated k times, k drawn from a Poisson distribution whose mean is its source's target
repetition rate; the draw inverts the distribution at a uniform number hashed from seed and doc_id, so a
rerun, another partitioning or a lost executor gives the same rows. A large rate is drawn in pieces: the sum
of m draws of mean rate / m has the distribution of one of mean rate, so no rate is too large. Copies are
spread by a hash of (seed, doc_id, copy), which is a global shuffle: each has its own random place, in any
partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import partitions, table, written

#: Mean of one draw, at most: the distribution of a source is a list of some hundred numbers at any rate.
PIECE_RATE = 32.0
#: Names and lists of all sources are broadcast up to so many bytes; beyond, the join shuffles, and AQE splits a hot source.
BROADCAST_BYTES = 8 << 20
SEED = "mix-1"


def uniform(seed: str, *cols: Column) -> Column:
    """52 bits of an md5 over the seed and the columns, as a double in [0, 1)."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """source, n, rate: expected copies of one document so that the mix has epochs * (rows of docs) rows.

    Weights are the given ones (a source that is not named gets 0), or else n ** power, which lifts small
    sources against large ones. n counts all rows of each source; null is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        named = [F.when(F.col("source").eqNullSafe(k), float(v)) for k, v in weights.items()]
        weight = F.coalesce(*named, F.lit(0.0)) if named else F.lit(0.0)
    counts = written(counts.withColumn("weight", weight), "mix-counts")
    rows, mass = counts.agg(F.sum("n"), F.sum("weight")).head()
    scale = epochs * (rows or 0) / mass if mass else 0.0
    return counts.select("source", "n", (F.lit(scale) * F.col("weight") / F.col("n")).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... up to far in the tail."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def add(acc, j):
        p = acc["p"] * rate / j
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add)["c"]


def draws(rate: Column) -> Column:
    """Number of pieces that a rate is drawn in."""
    return F.greatest(F.lit(1), F.ceil(rate / PIECE_RATE)).cast("int")


def times(seed: str, doc_id: Column, n: Column, steps: Column) -> Column:
    """The sum of n draws from steps; the first is hashed from doc_id alone, others from their number too."""

    def draw(u: Column) -> Column:
        return F.size(F.filter(steps, lambda c: c <= u))

    more = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), lambda k, j: k + draw(uniform(seed, doc_id, F.lit("draw"), j)))
    return draw(uniform(seed, doc_id)) + F.when(n > 1, more).otherwise(0)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs' own columns, plus copy (from 0) and mix_key (the place in the shuffled order).

    A document appears as often as its draw says, or not at all. Repeated rows of one doc_id draw alike;
    a null doc_id draws as an empty one; a null or empty text is replicated like any other. An empty table
    gives an empty one. Columns of docs named copy, mix_key or rate are replaced, all others are kept.
    """
    spark = docs.sparkSession
    docs = docs.drop("copy", "mix_key", "rate")
    names = docs.columns
    rates = target_rates(docs.select("source"), weights, power, epochs)
    # a row goes as a whole, so that helper names don't meet the table's
    docs = docs.select("doc_id", "source", F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    n = draws(F.col("rate"))
    steps = rates.filter("rate > 0").select(F.col("source").alias("_mix_source"), n.alias("_mix_draws"), poisson_steps(F.col("rate") / n).alias("_mix_steps"))
    most = 8 * (PIECE_RATE + 12 * PIECE_RATE**0.5 + 31) + 64  # bytes of a list and what goes with it
    if (rates.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + most)).head()[0] or 0) <= BROADCAST_BYTES:
        steps = F.broadcast(steps)
    drawn = docs.join(steps, F.col("source").eqNullSafe(F.col("_mix_source")))
    drawn = drawn.withColumn("_mix_times", times(seed, F.col("doc_id"), F.col("_mix_draws"), F.col("_mix_steps"))).filter("_mix_times > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mix_times") - 1)))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string"))))
    return copies.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "copy", "mix_key").repartition(partitions(spark), "mix_key").sortWithinPartitions("mix_key")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op10_source_mix": op10_source_mix}
ORACLES = {
    "op10_source_mix": f"""
    WITH RECURSIVE counts AS (
      SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
    rates AS (
      SELECT source, (SELECT sum(n) FROM counts) / (SELECT sum(weight) FROM counts) * weight / n AS whole FROM counts),
    pieces AS (
      SELECT source, greatest(1, ceil(whole / {PIECE_RATE}))::INTEGER AS m, whole / greatest(1, ceil(whole / {PIECE_RATE}))::INTEGER AS rate FROM rates),
    steps(source, rate, j, p, c) AS (
      SELECT source, rate, 0, exp(-rate), exp(-rate) FROM pieces
      UNION ALL
      SELECT source, rate, j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM steps
      WHERE j < ceil(rate + 12 * sqrt(rate) + 30)),
    lists AS (SELECT s.source, any_value(m) AS m, list(c ORDER BY j) AS cs FROM steps s JOIN pieces p ON s.source IS NOT DISTINCT FROM p.source GROUP BY s.source),
    asked AS (
      SELECT d.*, cs, unnest(range(m)) AS draw FROM (SELECT *, row_number() OVER () AS row FROM documents) d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source),
    drawn AS (
      SELECT row, doc_id, text, lang, source, n_chars, sum(len(list_filter(cs, lambda x: x <=
        ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || CASE WHEN draw > 0 THEN '|draw|' || draw ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0)))::BIGINT AS times
      FROM asked GROUP BY ALL)
    SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS mix_key
    FROM (SELECT *, unnest(range(times)) AS copy FROM drawn WHERE times > 0)
    """
}
