"""Where a diff's facts come from: the chain of foreign keys from a diff to the pages it rests on, on bucketed tables.

Each table is kept in buckets of the key that the next one refers to, sorted by it; facts carry the keys of the run and the
diff besides, as their batch is written once with all three. So the join of all of a day's diffs takes no shuffle of
facts, and the chain of one diff reads one bucket of the large table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of the chain, and the key that each is bucketed by.
CHAIN = {"diffs": "fact_set", "fact_sets": "fact_set", "facts": "fact_set"}


def save_bucketed(tables: dict[str, DataFrame], prefix: str, buckets: int = 32) -> None:
    """Write diffs, fact_sets and facts as tables `prefix`_name in buckets of fact_set; runs and artifacts as plain ones."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if name in CHAIN:
            # one file a bucket, whatever the number of tasks before
            writer = df.repartition(buckets, CHAIN[name]).write.mode("overwrite").format("parquet").bucketBy(buckets, CHAIN[name]).sortBy(CHAIN[name])
        writer.saveAsTable(f"{prefix}_{name}")


def provenance(spark: SparkSession, prefix: str, diff: int | None = None) -> DataFrame:
    """diff, fact, raw_key, canonical_key, confidence, extractor, url of a diff's facts, or of all diffs'.

    diffs (diff, fact_set), fact_sets (fact_set, run), facts (fact, fact_set, raw_key, canonical_key, confidence), runs (run,
    artifact, extractor), artifacts (artifact, url). Facts of no diff, and of sets without a run or an artifact, have no row.
    """
    t = lambda name: spark.table(f"{prefix}_{name}")
    diffs = t("diffs") if diff is None else t("diffs").filter(F.col("diff") == diff)
    chain = diffs.select("diff", "fact_set").hint("merge").join(t("fact_sets").hint("merge"), "fact_set").join(t("facts").hint("merge"), "fact_set")
    origin = t("runs").join(t("artifacts"), "artifact").select("run", "extractor", "url")
    return chain.join(origin, "run").select("diff", "fact", "raw_key", "canonical_key", "confidence", "extractor", "url")


def fact_confidence(spark: SparkSession, prefix: str) -> DataFrame:
    """diff, facts, confidence: number and mean confidence of each diff's facts, summed in the buckets they are in."""
    t = lambda name: spark.table(f"{prefix}_{name}")
    joined = t("diffs").select("diff", "fact_set").hint("merge").join(t("facts").hint("merge"), "fact_set")
    return joined.groupBy("fact_set", "diff").agg(F.count("*").alias("facts"), F.round(F.avg("confidence"), 9).alias("confidence"))
