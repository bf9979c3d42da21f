import pytest

LONG = " ".join(f"word{i % 977}x{i}" for i in range(30000))
PASSAGE = "a passage of some length that two documents have in common, with enough words to be over the bound by far; it goes on and on."


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns that clash."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and then it rests a while", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog and then it rests a while", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog and then it rests a while", "en", None),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, " \n\t ", "de", "b"),
        (6, LONG, "en", "a"),
        (7, "one", "en", "c"),
        (8, "one two", None, "c"),
        (9, "x " + PASSAGE + " y", "fr", "b"),
        (10, "é" + PASSAGE + "ü z", "fr", "b"),
        (None, "no id here but some words to count in the text of it", "en", "a"),
        (None, None, None, None),
        (11, "ab ab ab ab ab ab ab ab ab ab ab ab ab ab", "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    for name in ("n_chars", "score", "copy", "kept", "n_words", "bucket", "key", "steps", "label", "n_bytes", "piece", "runs", "ours", "rest", "row", "_mix_steps", "_mix_source", "least"):
        docs = docs.withColumn(name, F.lit(7).cast("long"))
    return docs


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
