"""Canonical addresses: own cases for each rule."""

from pyspark.sql import functions as F

from factloom.functions import scalars as S

CASES = [
    ("https://lamp.test/a?utm_campaign=q&colour=red&fbclid=9", "https://lamp.test/a?colour=red"), ("https://lamp.test/a?msclkid=1&_ga=2", "https://lamp.test/a"), ("https://lamp.test/b///", "https://lamp.test/b"),
    ("https://lamp.test", "https://lamp.test/"), ("HTTPS://LAMP.test/Desk/LED", "https://lamp.test/Desk/LED"), ("https://lamp.test:443/x", "https://lamp.test/x"), ("http://lamp.test:443/x", "http://lamp.test:443/x"), ("http://lamp.test:80/x", "http://lamp.test/x"),
    ("https://www.amazon.de/lamp/dp/B000TEST00/ref=abc_1", "https://www.amazon.de/lamp/dp/B000TEST00"), ("https://notamazon.test/x/ref=abc", "https://notamazon.test/x/ref=abc"), ("https://lamp.test/x#part-2", "https://lamp.test/x#part-2"), ("https://lamp.test/x#", "https://lamp.test/x"),
    ("mailto:a@lamp.test", "mailto:a@lamp.test"), ("lamp", "lamp"), ("", ""), (None, None), ("https://Ann:Key@lamp.test/?Th=1&th=2&b&b", "https://Ann:Key@lamp.test/?Th=1&b&b"), (" https://lamp.test/y ", "https://lamp.test/y"),
]


def test_canonical_addresses(spark):
    rows = spark.createDataFrame(list(enumerate(u for u, _ in CASES)), "n int, url string").select("n", S.canonical_url(F.col("url")).alias("u")).collect()
    assert {r.n: r.u for r in rows} == dict(enumerate(v for _, v in CASES))
