"""Pages: structured blocks, properties, clean text and tests of what came back, in SQL functions on the raw HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import let, lookup

# Property names and the raw keys they give; marks of walls; named entities.
MICRODATA = {"name": "title", "brand": "brand", "price": "base_price", "priceCurrency": "currency", "description": "description", "image": "images", "sku": "mpn", "gtin13": "gtin", "gtin12": "gtin"}
OPENGRAPH = {"og:title": "title", "og:description": "description", "og:image": "images", "product:price:amount": "base_price", "product:price:currency": "currency", "product:brand": "brand", "product:retailer_item_id": "mpn"}
CAPTCHA = r"(?i)captcha|robot check|are you human|access denied|pardon our interruption"
ANTI_BOT = r"(?i)Access\s+Denied|Just\s+a\s+moment|Verifying\s+you\s+are\s+human|cf-browser-verification|captcha-delivery|unusual\s+traffic|<title>Attention Required"
STRUCTURED = r"(?i)application/ld\+json|__NEXT_DATA__|itemprop=|property=[\"']og:"
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&cent;": "¢",
    "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&laquo;": "«", "&raquo;": "»", "&ldquo;": "“", "&rdquo;": "”", "&lsquo;": "‘", "&rsquo;": "’", "&bull;": "•", "&times;": "×", "&amp;": "&",
}
MAX_BYTES = 4 * 1024 * 1024


def script_blocks(html: Column, kind: str = r"application/ld\+json") -> Column:
    """Bodies of all scripts of a type, in order; an array."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<script[^>]*type=[\"']{kind}[\"'][^>]*>([^<]*+(?:<(?!/script)[^<]*+)*+)</script>"), F.lit(1))


def script_by_id(html: Column, name: str) -> Column:
    """Body of the first script with an id, or null."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<script[^>]*\bid=[\"']{name}[\"'][^>]*>(.*?)</script>", 1), F.lit(""))


def window_assignment(html: Column, name: str) -> Column:
    """JSON text assigned to window.<name>, or null."""
    return F.nullif(F.regexp_extract(html, rf"(?s)window\.{name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1), F.lit(""))


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, or null where it is missing or empty."""
    pattern = rf"(?i)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(attrs, pattern, i)), F.lit("")) for i in (1, 2, 3)])


def has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attribute(attrs, "class"), F.lit("")), r"\s+"), name)


def page_title(html: Column) -> Column:
    """First of og:title, h1 and title without its suffix; struct of value and confidence."""
    og = F.regexp_extract(html, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']+)", 1)
    h1 = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", ""))
    title = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+[-–|]\s+[^-–|]+$", ""))
    one = lambda v, c: F.struct(v.alias("value"), F.lit(c).alias("confidence"))
    best = F.when(og != "", one(og, 0.85)).when(h1 != "", one(h1, 0.75)).when(title != "", one(title, 0.55))
    return let(best, lambda b: F.when(b.isNotNull(), F.struct(decode(b["value"]).alias("value"), b["confidence"].alias("confidence"))))


def decode(text: Column) -> Column:
    """Named and numeric entities as characters, &amp; last; a number that is no character stays as it is."""

    def char(ref: Column) -> Column:
        code = F.when(ref.rlike("^&#[xX]"), F.conv(F.regexp_extract(ref, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(ref, "^&#([0-9]+);", 1)).try_cast("long")
        plane = code - 0x10000
        units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.lpad(F.hex(0xD800 + F.shiftright(plane, 10)), 4, "0"), F.lpad(F.hex(0xDC00 + plane.bitwiseAND(0x3FF)), 4, "0")))
        fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(fine, F.decode(F.unhex(units), "UTF-16BE")).otherwise(ref)

    refs = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    text = let(text, lambda t: F.when(t.contains("&#"), F.aggregate(refs(t), t, lambda s, r: F.replace(s, r, char(r)))).otherwise(t))
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def up_to_last(text: Column, end: str, f) -> Column:
    """text with f applied up to the last place of a pattern: beyond it nothing can end there, and so a search that looks
    for the end from each beginning stays linear, whatever is left open."""
    head = lambda t: F.regexp_extract(t, f"(?is)^.*(?:{end})", 0)
    return let(text, lambda t: F.when(t.rlike(f"(?is){end}"), let(head(t), lambda h: F.concat(f(h), F.substring(t, F.length(h) + 1, F.length(t))))).otherwise(t))


HIDDEN = ["script", "style", "noscript", "svg", "nav", "footer"]


def clean(html: Column, most: int = 200_000) -> Column:
    """Readable text: no scripts, styles, comments, pictures, navigation; links as `text (href)`; a line for a block.

    Longer results keep their two ends in equal parts.
    """
    t = html
    for name in HIDDEN:
        t = up_to_last(t, rf"</{name}\s*>", lambda h: F.regexp_replace(h, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " "))
    t = up_to_last(t, "-->", lambda h: F.regexp_replace(h, r"(?s)<!--.*?-->", " "))
    t = F.regexp_replace(t, r"(?is)<img[^>]*\balt=[\"']([^\"']+)[\"'][^>]*>", " $1 ")
    t = up_to_last(t, r"</a\s*>", lambda h: F.regexp_replace(h, r"(?is)<a\s[^>]*\bhref=[\"']([^\"']+)[\"'][^>]*>(.*?)</a\s*>", "$2 ($1)"))
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header)\b[^>]*>", "\n")
    t = decode(F.regexp_replace(t, r"<[^>]+>", " "))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\x0B\f\r]+", " "), r" ?\n ?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"\n{2,}", "\n"), r"^\s+|\s+$", "")
    half = most // 2
    return let(t, lambda x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(half)), F.lit("\n…\n"), F.right(x, F.lit(half)))).otherwise(x))


def captcha_wall(html: Column) -> Column:
    return (F.length(html) < 10_000) & html.rlike(CAPTCHA)


def anemic(html: Column) -> Column:
    """Too little to read: under 5 kB, an anti-bot mark, or under 30 kB without any structured data."""
    n = F.length(html)
    return html.isNull() | (n < 5 * 1024) | html.rlike(ANTI_BOT) | (~html.rlike(STRUCTURED) & (n < 30 * 1024))


def escalate_to_browser(html: Column, coverage: Column) -> Column:
    """Two at least of: under 30 kB, asks for scripts, no structured data, coverage under a half."""
    marks = [F.length(html) < 30 * 1024, html.rlike(r"(?is)<noscript[^>]*>[^<]*javascript"), ~html.rlike(STRUCTURED), coverage < 0.5]
    total = F.lit(0)
    for m in marks:
        total = total + F.coalesce(m, F.lit(False)).cast("int")
    return total >= 2


def coverage_tier(html: Column) -> Column:
    """Share of attributes one may expect, by the kind of data in the page."""
    ld, app = html.rlike(r"(?i)application/ld\+json"), html.rlike(r"__NEXT_DATA__|__NUXT__")
    return F.when(captcha_wall(html), 0.1).when(ld, 0.8).when(app, 0.7).otherwise(0.3)


def readable(pages: DataFrame) -> DataFrame:
    """Pages (html) that parsers read: of up to MAX_BYTES, and no captcha wall."""
    return pages.filter((F.octet_length("html") <= MAX_BYTES) & ~F.coalesce(captcha_wall(F.col("html")), F.lit(True)))


#: What a parser gives: its facts in the order that they arrive in.
FOUND = "array<struct<raw_key:string,value:string,confidence:double,parser:string,ordinal:int>>"


def property_array(html: Column) -> Column:
    """FOUND of a page's microdata (.80) and OpenGraph (.65)."""
    item = r"(?is)<[a-z][^>]*\bitemprop=[\"']([A-Za-z0-9]+)[\"'][^>]*\bcontent=[\"']([^\"']*)[\"']"
    body = r"(?is)<[a-z][a-z0-9]*[^>]*\bitemprop=[\"']([A-Za-z0-9]+)[\"'][^>]*>([^<]+)<"
    meta = r"(?is)<meta[^>]*\bproperty=[\"']([^\"']+)[\"'][^>]*\bcontent=[\"']([^\"']*)[\"']"

    def of(pattern: str, names: dict, parser: str, confidence: float, offset: int, mark: str) -> Column:
        keys, values = (F.regexp_extract_all(html, F.lit(pattern), F.lit(g)) for g in (1, 2))
        each = lambda kv, i: F.struct(lookup(names, kv["k"]).alias("raw_key"), decode(F.trim(kv["v"])).alias("value"), F.lit(confidence).alias("confidence"), F.lit(parser).alias("parser"), (i + offset).alias("ordinal"))
        rows = F.filter(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), each), lambda f: f["raw_key"].isNotNull() & (f["value"] != ""))
        return F.coalesce(F.when(F.contains(html, F.lit(mark)), rows).cast(FOUND), F.array().cast(FOUND))

    micro = F.concat(of(item, MICRODATA, "microdata", 0.80, 0, "itemprop"), of(body, MICRODATA, "microdata", 0.80, 10_000, "itemprop"))
    first = let(micro, lambda all_: F.aggregate(all_, F.array().cast(FOUND), lambda had, f: F.when(F.exists(had, lambda g: g["raw_key"] == f["raw_key"]), had).otherwise(F.array_append(had, f))))
    return F.concat(first, of(meta, OPENGRAPH, "opengraph", 0.65, 20_000, "property"))


def property_facts(pages: DataFrame, page: str = "page_id") -> DataFrame:
    """page, raw_key, value, confidence, parser, ordinal from microdata and OpenGraph of captcha-free pages."""
    return readable(pages).select(F.col(page).alias("page"), F.explode(property_array(F.col("html"))).alias("f")).select("page", "f.*")


def breadcrumb(crumbs: Column) -> Column:
    """Category path of an array of structs (position, name): by position, without the last, lower case."""
    ordered = F.array_sort(F.transform(crumbs, lambda c: F.struct(F.coalesce(c["position"].cast("double"), F.lit(float("inf"))).alias("p"), F.lower(F.trim(c["name"])).alias("n"))))
    return F.array_join(F.transform(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda c: c["n"]), "/")


def coverage(facts: DataFrame, required: list[str]) -> DataFrame:
    """page, gaps: core and required keys without a fact."""
    core = ["title", "base_price", "currency", "productType"]
    return facts.groupBy("page").agg(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in dict.fromkeys(core + required)]), F.collect_set("raw_key"))).alias("gaps"))
