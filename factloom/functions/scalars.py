"""Scalar functions on columns: text, identifiers, URLs, units, keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Unit -> (dimension, canonical unit, factor); no factor: not convertible.
UNITS = {
    "in": ("length", "cm", 2.54),
    "cm": ("length", "cm", 1.0),
    "mm": ("length", "cm", 0.1),
    "m": ("length", "cm", 100.0),
    "ft": ("length", "cm", 30.48),
    "g": ("mass", "g", 1.0),
    "kg": ("mass", "g", 1000.0),
    "oz": ("mass", "g", 28.3495),
    "lb": ("mass", "g", 453.592),
    "ml": ("volume", "ml", 1.0),
    "l": ("volume", "ml", 1000.0),
    "L": ("volume", "ml", 1000.0),
    "Wh": ("energy", "Wh", 1.0),
    "mAh": ("energy", "Wh", None),
    "W": ("power", "W", 1.0),
    "kW": ("power", "W", 1000.0),
    "Hz": ("frequency", "Hz", 1.0),
    "kHz": ("frequency", "Hz", 1000.0),
}
# Query parameters dropped from URLs, besides those that start with utm_.
TRACKING = ["_ga", "_gl", "fbclid", "gclid", "mc_eid", "mc_cid", "msclkid", "ref", "ref_", "crid", "dib", "dib_tag", "keywords", "qid", "sprefix", "sr", "th", "psc"]
# Country domain -> currency, for the choice among offers.
OFFER_CURRENCY = {"in": "INR", "au": "AUD", "uk": "GBP", "gb": "GBP", "ca": "CAD", "jp": "JPY", "de": "EUR", "fr": "EUR", "it": "EUR", "es": "EUR", "nl": "EUR", "ie": "EUR", "eu": "EUR", "nz": "NZD", "sg": "SGD", "my": "MYR", "ae": "AED", "za": "ZAR"}
# Names of variant axes.
AXIS_ALIASES = {"color": "color", "colour": "color", "color_family": "color", "colour_family": "color", "colorway": "color", "size": "size", "size_uk": "size", "size_us": "size", "size_eu": "size", "size_in": "size", "size_inch": "size", "ram": "ram", "storage": "storage"}


def lookup(mapping: dict, key: Column) -> Column:
    """mapping[key], or null; for small fixed mappings."""
    if not mapping:
        return F.lit(None)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def slug(c: Column) -> Column:
    """Lower case, other runs than a-z and 0-9 to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def gtin(c: Column) -> Column:
    """Without spaces and dashes and leading zeros; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[\s-]", ""), "^0+", "")
    return F.when(bare != "", bare)


def normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, of lower-cased and trimmed texts; 1 for two empty ones."""
    a, b = normal(a), normal(b)
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def _jaro_winkler(a: str, b: str) -> float:
    a, b = a.lower().strip(), b.lower().strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(hits, other, strict=True)) / 2
    m = len(hits)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity with prefix weight .1 up to four characters, always applied; null counts as empty."""
    return pd.Series([_jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def canonical_json(c: pd.Series) -> pd.Series:
    """JSON text with keys sorted at every depth; null where it is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return c.map(one)


def strip_key(name: str):
    """A function that drops every object member called `name`, at any depth, from JSON text; null for what is none."""

    def prune(v):
        if isinstance(v, dict):
            return {k: prune(x) for k, x in v.items() if k != name}
        return [prune(x) for x in v] if isinstance(v, list) else v

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(prune(json.loads(x)), separators=(",", ":"), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(StringType())
    def strip(c: pd.Series) -> pd.Series:
        return c.map(one)

    return strip


def cluster_key(dims: dict[str, Column]) -> Column:
    """First 16 hex digits of the sha256 of the JSON object of dims, keys sorted, nulls left out."""
    entries = F.array_sort(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in dims.items()]), lambda e: e["value"].isNotNull()))
    return F.substring(F.sha2(F.to_json(F.map_from_entries(entries)), 256), 1, 16)


def host_of(url: Column) -> Column:
    """Lower-cased host without www.; empty for what is no URL."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", ""), F.lit(""))


def loose_host(url: Column) -> Column:
    """Host as a report groups by it: without scheme, path, port and www."""
    return F.regexp_replace(F.split_part(F.split_part(F.regexp_replace(F.lower(url), "^[a-z]+://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)), r"^www\.", "")


def tld(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, tracking parameters dropped, no slash at the path's end; fragments stay.

    Other parameters keep their order and their repeats; names of parameters are compared as they are written, user
    information stays as it is, and a port that is the scheme's own goes. On one marketplace's hosts, path segments that begin with ref= go too. What is no http(s) URL stays as it is.
    """
    m = r"^\s*([A-Za-z]+)://([^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(#.*?)?\s*$"
    part = lambda i: F.regexp_extract(F.regexp_replace(url, r"\s+$", ""), m, i)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    kept = F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~name(p).isin(TRACKING) & ~name(p).startswith("utm_"))
    scheme = F.lower(part(1))
    host = F.regexp_replace(F.lower(part(3)), F.when(scheme == "https", ":443$").otherwise(":80$"), "")
    slashed = F.when(part(4) == "", "/").otherwise(part(4))
    path = F.regexp_replace(slashed, "(.)/+$", "$1")
    path = F.when(F.regexp_replace(host, r":\d+$", "").rlike(r"(^|\.)amazon\.[a-z.]+$"), F.regexp_replace(path, "/ref=[^/]+", "")).otherwise(path)
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    made = F.concat(scheme, F.lit("://"), part(2), host, F.when(path == "", "/").otherwise(path), query, F.when(part(6) == "#", "").otherwise(part(6)))
    return F.when(url.rlike(r"^\s*(?i)https?://([^/?#@]*@)?[^/?#@]+"), made).otherwise(url)


def to_canonical_unit(value: Column, unit: Column, dimension: Column | None = None) -> Column:
    """Value in the unit's canonical one; null for unknown units, other dimensions and units without a factor."""
    factor = lookup({u: f for u, (_, _, f) in UNITS.items() if f is not None}, unit)
    out = value * factor
    return out if dimension is None else F.when(lookup({u: d for u, (d, _, _) in UNITS.items()}, unit) == dimension, out)


def axis_name(c: Column) -> Column:
    """Slug of a variant axis, and its common name where it has one."""
    flat = slug(F.regexp_replace(c, r"[()]", " "))
    return F.coalesce(lookup(AXIS_ALIASES, flat), flat)


def axis_value(axis: Column, value: Column) -> Column:
    """Colours in title case, letter sizes in upper case, others trimmed."""
    v = F.regexp_replace(F.trim(value), r"\s+", " ")
    letters = v.rlike(r"^(?i)(x{0,4}[sml]|\d?xl|\d?xs)$")
    return F.when(axis == "color", F.initcap(v)).when((axis == "size") & letters, F.upper(v)).otherwise(v)


def loose_number(c: Column) -> Column:
    """The digits and dots of a text as a number: 1,299.00 is 1299."""
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """c kept in low to high; null stays."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def backoff_ms(attempt: Column, base: float = 3000.0, most: float = 600000.0, jitter: float = 0.0, key: Column | None = None) -> Column:
    """Milliseconds to wait before an attempt (from 0); with jitter, up to that share of it less, drawn from key and attempt."""
    wait = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
    if not jitter:
        return wait
    draw = F.pmod(F.xxhash64(key if key is not None else F.lit(0), attempt), F.lit(1 << 30)) / float(1 << 30)
    return wait * (1 - jitter * draw)
