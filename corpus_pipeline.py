"""From raw documents to packed sequences, in five stages.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame; its result is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import best_fit, nbsvm, near_dup, source_mix, suffix_dedup
from factloom.llm.common import deleted, scratch, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it is fitted to those of labels that are in docs.

    Null and empty texts and rows without a doc_id are scored like others, repeated rows alike; without labels of both
    classes all have the prior's verdict. An empty table stays empty; columns beyond those of documents go.
    """
    return nbsvm.classify(docs.select(COLUMNS), table(spark, sf_dir, "labels")).filter("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that of the least doc_id.

    Repeated rows of one doc_id and text count once; rows without a doc_id all stay, and so do null and wordless texts,
    which are no one's duplicates. An empty table stays empty; columns beyond those of documents go.
    """
    docs = docs.select(COLUMNS)
    kept = near_dup.near_duplicates(docs, size=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept.hint("merge"), "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("lang", "source", "n_chars"))
    named = named.withColumn("_first", first).filter("_first = 1").select(COLUMNS)
    return named.unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what stands in an earlier document or earlier in the same, from 100 bytes on.

    A character of which a repeat has only some bytes stays. Null texts stay null, rows without a doc_id and all but one of
    the texts of a doc_id pass whole. n_chars is the new text's. An empty table stays empty; other columns go.
    """
    done = suffix_dedup.remove_repeats(docs.select(COLUMNS), as_text=True)
    text = F.when(F.size("removed_spans") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, in shuffled order.

    A null source is a source; null texts and repeated rows are drawn like others, rows of one doc_id alike, rows without
    one as an empty one. An empty table stays empty; columns beyond those of documents go.
    """
    return source_mix.mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence of a permitted length.

    A null or empty text has its end token alone; rows of one doc_id, null too, are documents of their own. An empty
    table gives no places; other columns are not read.
    """
    return best_fit.pack_documents(docs, best_fit.byte_tokens())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed", mixed),
    ("packed", packed),
]
#: SQL can't express the classifier, the signatures or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables that no later stage reads are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as keep:
            done = written(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(done)
        if name != STAGES[0][0]:
            deleted(docs)
        docs = done
    return docs
