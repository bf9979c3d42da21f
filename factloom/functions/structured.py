"""Facts of all structured parsers of a page, from one scan and one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.elements import with_elements
from factloom.functions.html import FOUND, property_array, readable
from factloom.functions.inline import SWEPT, inline_array
from factloom.functions.jsonld import jsonld_array
from factloom.functions.records import next_array


def structured_facts(pages: DataFrame) -> DataFrame:
    """page, raw_key, value, confidence, parser, ordinal of pages (page_id, url, html).

    A null page, one over 4 MB and a captcha wall give none.
    """
    swept = with_elements(readable(pages).select(F.col("page_id").alias("page"), "url", "html"), SWEPT)
    html = F.col("html")
    parts = [property_array(html), jsonld_array(html, F.col("url")), inline_array(html, F.col("elements"), F.col("words")), next_array(html)]
    found = swept.select("page", F.concat(*[F.coalesce(p.cast(FOUND), F.array().cast(FOUND)) for p in parts]).alias("found"))
    return found.select("page", F.explode("found").alias("f")).select("page", "f.*")
