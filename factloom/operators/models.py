"""What models answered, as facts: text and vision extraction, gap filling, cost, and when to ask them at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.records import full, plain
from factloom.functions.scalars import clamp, lookup

# Dollars for a million tokens in and out; marks of pictures that hold what a text lacks.
PRICES = {
    "gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.0), "gpt-4-turbo": (10.0, 30.0), "gpt-3.5-turbo": (0.50, 1.50), "llama-3.3-70b-versatile": (0.59, 0.79),
    "llama-3.1-70b-versatile": (0.59, 0.79), "llama-3.1-8b-instant": (0.05, 0.08), "llama-3.2-90b-vision-preview": (0.90, 0.90), "llama-3.2-11b-vision-preview": (0.18, 0.18),
}
OTHER_PRICE = (1.0, 3.0)
SIZE_CHART = r"(?i)size[-_]?chart|sizing[-_]?(?:guide|chart)|size[-_]?guide"
SPEC_GRAPHIC = r"(?i)spec[-_]?image|specification[-_]?graphic|tech[-_]?specs[-_]?img"
PRICE_IMAGE = r"(?i)(?:price|sale|deal|discount)[-_]?(?:img|image|graphic|banner)"
CAROUSEL = r"(?i)class\s*=\s*[\"'][^\"']*(?:image-carousel|product-gallery|image-gallery|carousel)"
CREDIT_USD, CEILING_USD = 0.0001, 0.05
MOST_CONFIDENT, UNKNOWN_CONFIDENCE, VISION_CONFIDENCE = 0.85, 0.5, 0.70
#: Answer's member, raw key, and whether its text is trimmed.
ANSWER_TEXTS = [("title", "title", False), ("brand", "brand", False), ("gtin", "gtin", True), ("model_number", "model_number", True), ("description", "description", False)]
_ANSWER = """title string, brand string, gtin string, model_number string, description string, base_price double, currency string, category_path string,
category_confidence double, images array<struct<url:string,alt_text:string>>, attributes map<string,string>,
variants array<struct<sku:string,barcode:string,price:double,option_values:map<string,string>,inventory_quantity:bigint>>, error string,
_field_confidence map<string,double>, _broken string"""
_ROW = "array<struct<raw_key:string,value:string,confidence:double>>"


def answers(responses: DataFrame, content: str = "content") -> DataFrame:
    """responses with answer, a struct; null for what is no JSON of the agreed types, for shares beyond 0 to 1, for
    currencies of over three letters, and for an error without a title."""
    a = F.from_json(F.col(content), _ANSWER, {"columnNameOfCorruptRecord": "_broken"})
    x = F.col("answer")
    unit = lambda c: c.isNull() | c.between(0, 1)
    fine = x["_broken"].isNull() & unit(x["category_confidence"]) & (F.length(F.coalesce(x["currency"], F.lit(""))) <= 3) & F.forall(F.coalesce(F.map_values(x["_field_confidence"]), F.array().cast("array<double>")), unit)
    told = x["error"].isNull() | (x["error"] == "") | (F.coalesce(x["title"], F.lit("")) != "")
    return responses.withColumn("answer", a).withColumn("answer", F.when(F.coalesce(fine & told & F.col(content).rlike(r"^\s*\{"), F.lit(False)), x))


def answer_facts(responses: DataFrame, page: str = "page", content: str = "content") -> DataFrame:
    """page, raw_key, value, confidence, parser, ordinal of a text model's answers; nobody's confidence exceeds .85."""
    x = F.col("answer")
    sure = lambda key: F.least(F.lit(MOST_CONFIDENT), F.coalesce(F.try_element_at(x["_field_confidence"], F.lit(key) if isinstance(key, str) else key), F.lit(UNKNOWN_CONFIDENCE)))
    row = lambda key, value, said=None: F.struct((F.lit(key) if isinstance(key, str) else key).alias("raw_key"), value.cast("string").alias("value"), sure(said or key).alias("confidence"))
    some = lambda c: F.nullif(c, F.lit(""))
    top = [row(key, F.trim(some(x[name])) if cut else some(x[name])) for name, key, cut in ANSWER_TEXTS]
    urls = F.filter(F.transform(x["images"], lambda i: i["url"]), lambda u: u.startswith("http"))
    top += [row("base_price", plain(x["base_price"])), row("currency", F.upper(some(x["currency"]))), row("productType", some(x["category_path"]), "category_path"), row("images", F.when(F.size(urls) > 0, F.to_json(urls)))]
    attributes = F.transform(F.map_entries(x["attributes"]), lambda e: row(e["key"], some(e["value"])))

    def variant(v: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("variants["), i.cast("string"), F.lit("]."), name if isinstance(name, Column) else F.lit(name))
        own = [row(at("sku"), full(v["sku"]), "variants"), row(at("barcode"), full(v["barcode"]), "variants"), row(at("price"), plain(v["price"]), "variants")]
        options = F.transform(F.map_entries(v["option_values"]), lambda e: row(at(F.concat(F.lit("option."), e["key"])), e["value"], "variants"))
        return F.concat(F.array(*own).cast(_ROW), F.coalesce(options.cast(_ROW), F.array().cast(_ROW)))

    lists = [F.array(*top), attributes, F.flatten(F.transform(x["variants"], variant))]
    facts = F.filter(F.concat(*[F.coalesce(c.cast(_ROW), F.array().cast(_ROW)) for c in lists]), lambda f: f["value"].isNotNull())
    rows = answers(responses, content).filter("answer is not null").select(F.col(page).alias("page"), F.posexplode(facts).alias("ordinal", "f"))
    return rows.select("page", "f.raw_key", "f.value", "f.confidence", F.lit("llm").alias("parser"), "ordinal")


def wanted_gaps(facts: DataFrame, gaps: DataFrame) -> DataFrame:
    """Facts whose raw key is among the gaps (page, gaps) of their page: a gap-filling answer's other facts go."""
    return facts.join(gaps.select("page", "gaps"), "page").filter(F.array_contains("gaps", F.col("raw_key"))).select(*facts.columns)


def vision_facts(responses: DataFrame, page: str = "page", content: str = "content") -> DataFrame:
    """page, raw_key, value, confidence (.70), parser, ordinal of a vision model's answers, flat JSON objects."""
    entries = F.map_entries(F.from_json(content, "map<string,string>"))
    rows = responses.select(F.col(page).alias("page"), F.posexplode(entries).alias("ordinal", "e")).filter("e.value is not null and e.value <> ''")
    return rows.select("page", F.col("e.key").alias("raw_key"), F.col("e.value").alias("value"), F.lit(VISION_CONFIDENCE).alias("confidence"), F.lit("vision_llm").alias("parser"), "ordinal")


def cost_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    price = lambda i: F.coalesce(lookup({m: p[i] for m, p in PRICES.items()}, model), F.lit(OTHER_PRICE[i]))
    return (tokens_in * price(0) + tokens_out * price(1)) / 1_000_000


def vision_reasons(html: Column, has_price: Column, n_facts: Column) -> Column:
    """Why a picture may hold what the text lacks, in a fixed order."""
    signs = [("size_chart_image", html.rlike(SIZE_CHART)), ("spec_graphic_image", html.rlike(SPEC_GRAPHIC)), ("image_rendered_price", ~has_price & html.rlike(PRICE_IMAGE)), ("no_text_price_with_image_carousel", html.rlike(CAROUSEL) & ~has_price & (n_facts < 3))]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in signs]))


def to_vision(html: Column, has_price: Column, n_facts: Column) -> Column:
    """A reason at least, and under five facts or no price."""
    return (F.size(vision_reasons(html, has_price, n_facts)) > 0) & ((n_facts < 5) | ~has_price)


def within_ceiling(spent: Column, more: Column, ceiling: float = CEILING_USD) -> Column:
    """Whether credits spent and to be spent cost no more than the ceiling."""
    return (spent + more) * CREDIT_USD <= ceiling


def affordable(calls: DataFrame, by: list[str], order: list[str], credits: str = "credits", ceiling: float = CEILING_USD) -> DataFrame:
    """calls with spent (credits of the group's earlier calls) and allowed, whether the call still fits under the ceiling.

    Every call counts as spent, whether it was allowed or not; a group's calls are those of one ingestion.
    """
    before = F.coalesce(F.sum(credits).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("spent", before).withColumn("allowed", within_ceiling(F.col("spent"), F.col(credits), ceiling))


def source_reliability(avg_confidence: Column) -> Column:
    """A domain's average confidence, kept in 0 to 1; .65 where it isn't known."""
    return F.coalesce(clamp(avg_confidence), F.lit(0.65))
