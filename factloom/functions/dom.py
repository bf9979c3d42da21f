"""Facts from a page's visible markup, for pages without structured data: one scan, no shuffle.

Tags are swept once for the intervals of their elements, and heuristics are SQL functions on those. Values are texts;
several options are a JSON array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.elements import below, counted, inner, text_of, with_elements
from factloom.functions.html import MAX_BYTES, attribute, decode, page_title, readable
from factloom.functions.scalars import let, slug

# What marks prices, icons, size suffixes and separators.
CURRENCY = r"(?:\$|€|£|₹|¥)\s*([\d,]+(?:\.\d{1,2})?)|([\d,]+(?:\.\d{1,2})?)\s*(?:USD|EUR|GBP|INR|JPY)"
PRICE_CLASS = "price|amount|cost"
ICON = r"(?i)/(favicon|icon|sprite|logo)"
SIZE_SUFFIX = r"(?i)[_-]\d{2,4}x\d{2,4}(?=\.[a-z]{2,4}(?:$|\?))"
SEPARATORS = ["", ">", "/", "›"]
MOST_IMAGES, MOST_ALTERNATIVES, MOST_INNER, LEAST_PIXELS, LEAST_DESCRIPTION = 10, 3, 5, 200, 20
_FACT = "array<struct<raw_key:string,value:string,confidence:double,alternatives:array<string>>>"


def _all(html: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag's text; null where it is missing or empty."""
    return F.nullif(decode(F.trim(F.regexp_extract(tag, rf"(?i)^<[^>]*\s{name}=[\"']([^\"']*)[\"']", 1))), F.lit(""))


def _named(e: Column, name: str) -> Column:
    """Value of an element's attribute; null where it is missing or empty."""
    return decode(attribute(e["attrs"], name))


def _is(e: Column, *names: str) -> Column:
    return e["name"].isin(*names)


def _has(e: Column, pattern: str, *attributes: str) -> Column:
    """Whether one of an element's attributes fits a pattern."""
    out = F.lit(False)
    for a in attributes:
        out = out | F.coalesce(attribute(e["attrs"], a).rlike(pattern), F.lit(False))
    return e["attrs"].rlike(pattern) & out


def _fact(key, value: Column, confidence, alternatives: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>") if alternatives is None else alternatives
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(of(key).alias("raw_key"), value.alias("value"), of(confidence).alias("confidence"), none.alias("alternatives"))


def _bounded(elements: Column, times: int = 1) -> Column:
    """elements, or none where their texts together are longer than `times` pages may be: ones that nest thousands deep."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda n, e: n + e["end"] - e["start"])
    return let(elements, lambda x: F.when(total(x) <= times * MAX_BYTES, x).otherwise(F.slice(x, 1, 0)))


def price(html: Column, all_: Column, words: Column) -> Column:
    """The most confident price, of equals the least: itemprop (.90), then elements of a price's class (.65) with few inside."""
    number = lambda t: F.regexp_replace(F.trim(t), "[$,€£₹¥]", "").try_cast("double")
    marked = F.transform(F.filter(all_, lambda e: e["attrs"].contains("price") & F.coalesce(attribute(e["attrs"], "itemprop") == "price", F.lit(False))), lambda e: F.struct(F.lit(-0.90).alias("c"), number(F.coalesce(_named(e, "content"), text_of(words, e))).alias("v")))
    small = _bounded(F.filter(all_, lambda e: _has(e, f"(?i){PRICE_CLASS}", "class") & (e["inner"] <= MOST_INNER)), 16)
    amount = lambda t: F.regexp_replace(F.concat(F.regexp_extract(t, CURRENCY, 1), F.regexp_extract(t, CURRENCY, 2)), ",", "").try_cast("double")
    shown = F.transform(small, lambda e: F.struct(F.lit(-0.65).alias("c"), amount(text_of(words, e)).alias("v")))
    ranked = F.array_sort(F.filter(F.concat(marked, shown), lambda p: (p["v"] > 0) & (p["v"] < float("inf"))))
    as_text = lambda p: p["v"].cast("string")
    others = lambda all_: F.transform(F.slice(all_, 2, MOST_ALTERNATIVES), as_text)
    return let(ranked, lambda all_: F.transform(F.slice(all_, 1, 1), lambda p: _fact("base_price", as_text(p), -p["c"], others(all_))))


def images(html: Column, all_: Column, words: Column) -> Column:
    """og:image (.80), then img (.60): no data, icons or small ones; sizes of one picture count once."""
    size = lambda t, name: F.coalesce(_attribute(t, name).try_cast("double"), F.lit(0.0))
    large = lambda t, name: ~((size(t, name) > 0) & (size(t, name) < LEAST_PIXELS))
    og = F.transform(_all(html, r"(?i)<meta[^>]*\sproperty=[\"']og:image[\"'][^>]*>"), lambda t: F.struct(_attribute(t, "content").alias("u"), F.lit(0.80).alias("c")))
    tags = F.filter(_all(html, r"(?i)<img\b[^>]*>"), lambda t: large(t, "width") & large(t, "height"))
    img = F.transform(tags, lambda t: F.struct(F.coalesce(_attribute(t, "src"), _attribute(t, "data-src")).alias("u"), F.lit(0.60).alias("c")))
    found = F.filter(F.concat(og, img), lambda x: x["u"].isNotNull() & ~x["u"].startswith("data:") & ~x["u"].rlike(ICON))
    stem = lambda u: F.lower(F.regexp_replace(F.regexp_replace(u, r"\?.*", ""), SIZE_SUFFIX, ""))
    named = F.transform(found, lambda x: F.struct(x["u"].alias("u"), x["c"].alias("c"), stem(x["u"]).alias("s")))
    first = let(named, lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, lambda y: y["s"]), x["s"]) == i + 1))
    return F.transform(F.slice(first, 1, MOST_IMAGES), lambda x: _fact("image_url", x["u"], x["c"]))


def breadcrumb(html: Column, all_: Column, words: Column) -> Column:
    """Category path of the first breadcrumb element, without the last step; .50 and .10 for each of four steps.

    Steps are its list items, or else what is right inside it, or else what is a link or a span.
    """
    mark = "(?i)breadcrumb"
    one = F.get(F.filter(all_, lambda e: _has(e, mark, "class", "id") | (_is(e, "nav") & _has(e, mark, "aria-label"))), F.lit(0))

    def steps(elements: Column) -> Column:
        named = F.filter(F.transform(_bounded(elements), lambda e: text_of(words, e)), lambda s: ~s.isin(SEPARATORS))
        return let(named, lambda n: F.filter(n, lambda s, i: (i == 0) | (s != F.get(n, i - 1))))

    def found(e: Column) -> Column:
        inside = below(all_, e)
        listed, right, inline = F.filter(inside, lambda x: _is(x, "li")), inner(all_, e), F.filter(inside, lambda x: _is(x, "a", "span", "strong", "em"))
        return F.when(F.size(listed) > 0, steps(listed)).otherwise(let(steps(right), lambda r: F.when(F.size(r) > 0, r).otherwise(steps(inline))))

    chain = let(let(one, found), lambda s: F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda x: F.regexp_replace(F.lower(x), r"\s+", "_")))
    return let(chain, lambda c: F.when(F.size(c) > 0, F.array(_fact("category_path", F.array_join(c, "/"), F.round(F.least(F.size(c), F.lit(4)) * 0.10 + 0.50, 2)).cast(_FACT[6:-1]))))


def spec_table(html: Column, all_: Column, words: Column) -> Column:
    """Table rows of two cells and definition lists (.70)."""
    named = lambda *names: F.filter(all_, lambda e: _is(e, *names))
    pair = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    rows = F.filter(all_, lambda e: _is(e, "tr") & e["tabled"] & (e["past"] - e["first"] == 2))
    pairs = let(named("th", "td"), lambda cells: F.transform(rows, lambda r: let(counted(cells, r), lambda c: pair(c[0], c[1]))))

    def of(lists: Column) -> Column:
        few = lambda d: F.least(d["past"] - d["first"], d["past2"] - d["first2"])
        both = lambda d: F.zip_with(F.slice(counted(lists["k"], d), 1, few(d)), F.slice(counted(lists["v"], d, True), 1, few(d)), pair)
        return F.flatten(F.transform(named("dl"), both))

    defined = let(pair(named("dt"), named("dd")), of)
    facts = F.transform(F.concat(pairs, defined), lambda p: _fact(slug(text_of(words, p["k"])), text_of(words, p["v"]), 0.70))
    return F.filter(facts, lambda f: (f["raw_key"] != "") & (f["value"] != ""))


def variant_selectors(html: Column, all_: Column, words: Column) -> Column:
    """Options of each select and of each group of radio buttons (.65)."""
    option = lambda e: F.when(e["attrs"].rlike(r"(?i)(^|\s)value\s*="), F.nullif(F.trim(_named(e, "value")), F.lit(""))).otherwise(F.nullif(text_of(words, e), F.lit("")))
    chosen = lambda options, s: F.array_distinct(F.filter(F.transform(counted(options, s), option), lambda v: v.isNotNull()))
    selects = let(F.filter(all_, lambda e: _is(e, "option")), lambda options: F.transform(F.filter(all_, lambda e: _is(e, "select")), lambda s: F.struct(_named(s, "name").alias("k"), chosen(options, s).alias("v"))))
    buttons = F.transform(F.filter(all_, lambda e: _is(e, "input") & _has(e, "(?i)radio", "type")), lambda e: F.struct(_named(e, "name").alias("k"), _named(e, "value").alias("v")))
    buttons = F.filter(buttons, lambda b: b["k"].isNotNull() & b["v"].isNotNull())
    values = lambda all_, n: F.array_distinct(F.transform(F.filter(all_, lambda b: b["k"] == n), lambda b: b["v"]))
    radios = let(buttons, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda b: b["k"])), lambda n: F.struct(n.alias("k"), values(all_, n).alias("v"))))
    groups = F.filter(F.concat(selects, radios), lambda g: (F.size(g["v"]) > 0) & (slug(g["k"]) != ""))
    return F.transform(groups, lambda g: _fact(slug(g["k"]), F.to_json(g["v"]), 0.65))


def title(html: Column, all_: Column, words: Column) -> Column:
    t = page_title(html)
    return F.when(t.isNotNull(), F.array(_fact("title", t["value"], t["confidence"])))


def description(html: Column, all_: Column, words: Column) -> Column:
    """og:description (.80), the meta description (.70) or the longest element named so (.55); 20 characters at least."""
    meta = lambda a, v: _attribute(F.regexp_extract(html, rf"(?i)<meta[^>]*\s{a}=[\"']{v}[\"'][^>]*>", 0), "content")
    # what is inside another one is no longer than it
    none = F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("t"))

    def longer(had: Column, e: Column) -> Column:
        better = lambda t: F.struct(e["last"].alias("reach"), F.greatest(F.length(t), had["n"]).alias("n"), F.when(F.length(t) > had["n"], t).otherwise(had["t"]).alias("t"))
        return F.when(e["pre"] <= had["reach"], had).otherwise(let(text_of(words, e), better))

    longest = F.aggregate(F.filter(all_, lambda e: _has(e, "(?i)description", "class", "id")), none, longer)
    one = lambda v, c: F.struct(v.alias("v"), F.lit(c).alias("c"))
    found = F.filter(F.array(one(meta("property", "og:description"), 0.80), one(meta("name", "description"), 0.70), one(longest["t"], 0.55)), lambda d: F.length(d["v"]) >= LEAST_DESCRIPTION)
    return F.transform(F.slice(found, 1, 1), lambda d: _fact("description", d["v"], d["c"]))


#: In the order in which their facts arrive, each with what a page has where it could find anything.
HEURISTICS = [
    (price, f"(?i){PRICE_CLASS}"), (images, "(?i)<img|og:image"), (breadcrumb, "(?i)breadcrumb"), (spec_table, "(?i)<tr|<dl"),
    (variant_selectors, "(?i)<select|radio"), (title, "(?i)<h1|<title|og:title"), (description, "(?i)description"),
]


#: What a page has that any heuristic needs elements of.
SWEPT = "(?i)" + "|".join([PRICE_CLASS, "breadcrumb", "<tr|<dl", "<select|radio", "description"])


def dom_facts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, raw_key, value, confidence, alternatives, parser (dom), ordinal of all heuristics.

    A null page, one over 4 MB and a captcha wall have none. Steps of a breadcrumb that are longer together than a page may be,
    and prices that are longer than 16, come from elements that nest without end, and don't count.
    """
    swept = with_elements(readable(pages).select(F.col(page).alias("page"), "html"), SWEPT)
    html, all_, words = F.col("html"), F.col("elements"), F.col("words")
    found = F.concat(*[F.coalesce(F.when(html.rlike(mark), h(html, all_, words).cast(_FACT)), F.array().cast(_FACT)) for h, mark in HEURISTICS])
    rows = swept.select("page", F.posexplode(found).alias("ordinal", "f"))
    return rows.select("page", "f.*", F.lit("dom").alias("parser"), "ordinal")
