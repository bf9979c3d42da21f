"""Entity resolution: identities, blocked title matches, dedupe rules, match scores, field voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import gtin, jaro_winkler, normal, similarity

# Weights of the match score and the least scores of its actions.
MATCH_WEIGHTS = {"gtin": 0.40, "mpn": 0.20, "title": 0.25, "brand": 0.15}
MERGE, REVIEW, TITLE = 0.70, 0.40, 0.92


def identities(products: DataFrame) -> DataFrame:
    """product, type, value, position of gtin, mpn, brand:mpn, and of variants (sku, barcode) where products have them;
    distinct, nulls and blanks left out."""
    brand_mpn = F.concat_ws(":", F.lower(F.trim("brand")), F.lower(F.trim("mpn")))
    both = F.col("brand").isNotNull() & F.col("mpn").isNotNull()
    one = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    bare = lambda c: F.nullif(F.trim(c), F.lit(""))
    found = F.array(one("gtin", gtin(F.col("gtin"))), one("mpn", bare(F.col("mpn"))), one("brand_mpn", F.when(both, brand_mpn)))
    if "variants" in products.columns:
        own = F.flatten(F.transform("variants", lambda v: F.array(one("sku", bare(v["sku"])), one("gtin", gtin(v["barcode"])))))
        found = F.concat(found, F.coalesce(own, F.array().cast("array<struct<type:string,value:string>>")))
    # dealt by product before they are many: rows hardly ever repeat an identity, so to combine them where they are read only holds them
    rows = products.repartition("product").select("product", F.posexplode(found).alias("position", "i")).filter("i.value is not null")
    return rows.groupBy("product", "i.type", "i.value").agg(F.min("position").alias("position"))


def resolve_identity(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidate, product: the known product of a candidate's first identity that has one, of several the least.

    Known identities are reduced to one product per (type, value) before the join, so a value that many share
    gives no pairs.
    """
    one = known.groupBy("type", "value").agg(F.min("product").alias("known"))
    hits = candidates.withColumnRenamed("product", "candidate").join(one, ["type", "value"])
    return hits.groupBy("candidate").agg(F.min(F.struct("position", "known")).alias("b")).select("candidate", F.col("b.known").alias("product"))


def title_keys(df: DataFrame, title: str, least: float, probe: bool) -> DataFrame:
    """A row for each key of a title: two titles of a similarity of `least` or more have a key in common.

    The keys of the shorter (probe: False) are met by those of the longer (probe: True); at equal lengths either
    may be the shorter. A longer title of m characters may be d = (1 - least) m edits away. Up to d = 1 the keys are
    the title and what one deletion leaves of it. Beyond, the shorter is cut into d + 1 segments, one of which the
    edits leave alone: it stands in the longer, and no further from its place than the edits before and after it
    allow. Titles that differ without a single edit to spare (d = 0) have no keys: they are equal.
    """
    edits = lambda m: f"int(floor({1 - least + 1e-9!r} * {m} + 1e-9))"
    size, longest = "length(_k)", f"int(floor(length(_k) / {least - 1e-9!r} + 1e-9))"
    one = f"CASE WHEN {edits(longest)} >= 1 AND {edits(size)} <= 1 THEN array_distinct(concat(array(_k), transform(sequence(1, {size}), i -> concat(substring(_k, 1, i - 1), substring(_k, i + 1))))) ELSE array() END"
    one = f"transform({one}, s -> struct(0 AS size, 1 AS edits, 0 AS nth, s AS part))"
    cut = lambda i, n, d: f"({i} * {n} div ({d} + 1))"
    width = lambda n, d: f"int({cut('(i + 1)', n, d)} - {cut('i', n, d)})"
    if probe:
        d = edits(size)
        starts = f"filter(sequence(int({cut('i', 'n', 'd')}) - d, int({cut('i', 'n', 'd')}) + d), q -> q >= 0 AND q <= {size} - {width('n', 'd')} AND abs(q - {cut('i', 'n', 'd')}) <= i AND abs(q - {cut('i', 'n', 'd')} - {size} + n) <= d - i)"
        parts = f"flatten(transform(sequence(0, d), i -> transform({starts}, q -> struct(n AS size, d AS edits, i AS nth, substring(_k, q + 1, {width('n', 'd')}) AS part))))"
        many = f"flatten(transform(filter(array({d}), d -> d >= 2), d -> flatten(transform(sequence({size} - d, {size}), n -> {parts}))))"
    else:
        parts = f"transform(sequence(0, d), i -> struct({size} AS size, d AS edits, i AS nth, substring(_k, int({cut('i', size, 'd')}) + 1, {width(size, 'd')}) AS part))"
        many = f"flatten(transform(filter(sequence({edits(size)}, {edits(longest)}), d -> d >= 2), d -> {parts}))"
    return df.withColumn("_k", F.col(title)).withColumn("key", F.explode(F.expr(f"array_distinct(concat({one}, {many}))"))).drop("_k")


def title_pairs(a: DataFrame, b: DataFrame, block: list[str], least: float = TITLE) -> DataFrame:
    """Block, a, b, similarity of unlike titles a of the one and b of the other side that are similar.

    Both have the block's columns and t, a normal title, each once; if they are one frame, a pair is given once,
    its lesser title as a. Found by equal keys alone: see title_keys.
    """

    def met(shorter: DataFrame, longer: DataFrame, names: tuple[str, str]) -> DataFrame:
        x = title_keys(shorter.select(*block, F.col("t").alias("s")), "s", least, False)
        y = title_keys(longer.select(*block, F.col("t").alias("l")), "l", least, True)
        near = (F.col("s") != F.col("l")) & (F.length("l") - F.length("s") <= (1 - least) * F.length("l") + 1e-6)
        return x.join(y, [*block, "key"]).filter((F.length("s") <= F.length("l")) & near).select(*block, F.col("s").alias(names[0]), F.col("l").alias(names[1]))

    pairs = met(a, b, ("a", "b"))
    if a is b:
        pairs = pairs.select(*block, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    else:
        pairs = pairs.unionByName(met(b, a, ("b", "a")))
    pairs = pairs.distinct()
    return pairs.withColumn("similarity", F.round(similarity(F.col("a"), F.col("b")), 9)).filter(F.col("similarity") >= least)


def title_classes(rows: DataFrame, id_col: str, block: list[str], title: str, least: float = TITLE) -> DataFrame:
    """Pairs of distinct titles of a block that are similar, with the least id and number of rows of each.

    Rows of equal block and title are one class before anything is paired; classes are paired by title_pairs,
    whether or not they share a word.
    """
    t = rows.withColumn("t", normal(F.col(title))).filter("t is not null and t <> ''")
    classes = t.groupBy(*block, "t").agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    pairs = title_pairs(classes, classes, block, least)
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(*block, F.col("t").alias(side), F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}")), [*block, side])
    return pairs.select(*block, "id_a", "id_b", "n_a", "n_b", "similarity")


def category_fits(a: Column, b: Column) -> Column:
    """Equal, one the other's ancestor, or either unknown."""
    return a.isNull() | b.isNull() | (a == b) | a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))


def title_links(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """t, b: normal titles of the ones and similar (or equal) normal titles of the others; each title is compared once."""
    titles, known = (side.select(normal(F.col("title")).alias("t")).filter("t IS NOT NULL").distinct() for side in (candidates, existing))
    return title_pairs(titles, known, []).select(F.col("a").alias("t"), "b").unionByName(titles.select("t", F.col("t").alias("b")))


def _by_identifier(candidates: DataFrame, existing: DataFrame, links: DataFrame) -> DataFrame:
    """candidate, action (conflict, merge, review, new), product, by, title, category, one for each candidate.

    Both have product, gtin, brand, mpn, title, category. Rules in order: a gtin's hits in other categories
    conflict; one hit merges, unless both have a brand and another one, which is reviewed; several are reviewed; brand and mpn
    with a similar title and a fitting category: one merges, several are reviewed; else new. No pairs of rows arise: of a
    gtin one row is enough but for its categories, and those of a brand and mpn are met by links of titles, by equality.
    """
    c = candidates.select(F.col("product").alias("candidate"), gtin(F.col("gtin")).alias("g"), F.coalesce(normal(F.col("brand")), F.lit("")).alias("b"), normal(F.col("mpn")).alias("m"), normal(F.col("title")).alias("t"), "title", "category")
    e = existing.select("product", gtin(F.col("gtin")).alias("g"), F.coalesce(normal(F.col("brand")), F.lit("")).alias("b"), normal(F.col("mpn")).alias("m"), normal(F.col("title")).alias("t"), F.col("category").alias("ec"))
    brand = F.nullif("b", F.lit(""))
    by_gtin = e.filter("g is not null").groupBy("g").agg(F.count("*").alias("n"), F.min("product").alias("p"), F.min(brand).alias("b_least"), F.max(brand).alias("b_most"))
    by_category = e.filter("g is not null").groupBy("g", "ec").agg(F.min("product").alias("far"))
    far = c.filter("g is not null").select("g", "category").distinct().join(by_category, "g").filter(~category_fits(F.col("category"), F.col("ec"))).groupBy("g", "category").agg(F.min("far").alias("far"))
    same = (F.col("b") == "") | F.col("b_least").isNull() | ((F.col("b") == F.col("b_least")) & (F.col("b") == F.col("b_most")))
    g = c.join(by_gtin, "g").join(far, ["g", "category"], "left").groupBy("candidate").agg(F.sum("n").alias("g_hits"), F.bool_or(F.col("far").isNotNull()).alias("g_far"), F.min("p").alias("g_product"), F.min("far").alias("far_product"), F.bool_and(same).alias("g_brand"))
    all_ = c.join(g, "candidate", "left")
    # titles of a brand and mpn that are asked for, once each; then what they found meets the candidates' categories
    by_model = e.filter("m is not null and b <> ''").groupBy("b", "m", "t", "ec").agg(F.min("product").alias("p"), F.count("*").alias("n"))
    asked = all_.filter("g_hits is null and m is not null and b <> ''").select("candidate", "b", "m", "t", "category")
    near = asked.select("b", "m", "t").distinct().join(links.withColumnRenamed("b", "et"), "t")
    hits = near.join(by_model.withColumnRenamed("t", "et"), ["b", "m", "et"]).groupBy("b", "m", "t", "ec").agg(F.sum("n").alias("n"), F.min("p").alias("p"))
    m = asked.join(hits, ["b", "m", "t"]).filter(category_fits(F.col("category"), F.col("ec"))).groupBy("candidate").agg(F.sum("n").alias("m_hits"), F.min("p").alias("m_product"))
    all_ = all_.join(m, "candidate", "left")
    by = F.when(F.col("g_hits") > 0, "gtin").when(F.col("m_hits") > 0, "brand_mpn").otherwise("none")
    action = (
        F.when(F.col("g_far"), "conflict")
        .when((F.col("g_hits") == 1) & F.col("g_brand"), "merge")
        .when(F.col("g_hits") >= 1, "review")
        .when(F.col("m_hits") == 1, "merge")
        .when(F.col("m_hits") > 1, "review")
        .otherwise("new")
    )
    return all_.select("candidate", action.alias("action"), F.coalesce(F.when(F.col("g_far"), F.col("far_product")), "g_product", "m_product").alias("product"), by.alias("by"), "title", "category")


def dedupe(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """candidate, action (conflict, merge, review, new), product, by, one for each candidate.

    After the rules of identifiers, what would be new is reviewed if a product has a similar title and a fitting
    category. Titles are compared once each, by title_pairs, and categories by title and category: what a title's links find
    is one row for each category, whatever the number of titles that are like it.
    """
    links = title_links(candidates, existing)
    found = _by_identifier(candidates, existing, links).withColumn("t", normal(F.col("title")))
    asked = found.filter("action = 'new' AND t IS NOT NULL").select("t", "category").distinct()
    known = existing.select(normal(F.col("title")).alias("b"), F.col("category").alias("ec"), "product").filter("b IS NOT NULL").groupBy("b", "ec").agg(F.min("product").alias("t_product"))
    near = links.join(known, "b").groupBy("t", "ec").agg(F.min("t_product").alias("t_product"))
    hits = asked.join(near, "t").filter(category_fits(F.col("category"), F.col("ec"))).groupBy(F.col("t").alias("ht"), F.col("category").alias("hc")).agg(F.min("t_product").alias("t_product"))
    by_title = (F.col("action") == "new") & F.col("t_product").isNotNull()
    out = found.join(hits, (F.col("action") == "new") & (F.col("t") == F.col("ht")) & F.col("category").eqNullSafe(F.col("hc")), "left")
    return out.select("candidate", F.when(by_title, "review").otherwise(F.col("action")).alias("action"), F.when(by_title, F.col("t_product")).otherwise(F.col("product")).alias("product"), F.when(by_title, "title").otherwise(F.col("by")).alias("by"))


def match_score(signals: dict[str, Column]) -> Column:
    """Weighted mean of the signals that are there (null: not there); 0 if none is."""
    present = [(F.coalesce(signals[k], F.lit(0.0)) * w, F.when(signals[k].isNotNull(), w).otherwise(0.0)) for k, w in MATCH_WEIGHTS.items() if k in signals]
    top, below = present[0]
    for x, y in present[1:]:
        top, below = top + x, below + y
    return F.when(below > 0, top / below).otherwise(0.0)


def pair_signals(a: str, b: str) -> dict[str, Column]:
    """Signals of a pair of aliased products: equal gtin, equal mpn, titles by Jaro-Winkler, equal brand."""
    x, y = lambda n: F.col(f"{a}.{n}"), lambda n: F.col(f"{b}.{n}")
    equal = lambda p, q: F.when(p.isNotNull() & q.isNotNull(), (p == q).cast("double"))
    return {"gtin": equal(gtin(x("gtin")), gtin(y("gtin"))), "mpn": equal(normal(x("mpn")), normal(y("mpn"))), "title": F.when(x("title").isNotNull() & y("title").isNotNull(), jaro_winkler(x("title"), y("title"))), "brand": equal(normal(x("brand")), normal(y("brand")))}


def match_action(score: Column) -> Column:
    return F.when(score >= MERGE, "merge").when(score >= REVIEW, "review").otherwise("keep_separate")


def reconcile_fields(facts: DataFrame, by: list[str]) -> DataFrame:
    """value, source, confidence of each key: the most confident, then the newest, then the lesser source; nulls skipped."""
    best = facts.filter("value is not null").groupBy(*by).agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "source", "value")).alias("b"))
    return best.select(*by, F.col("b.value").alias("value"), F.col("b.source").alias("source"), (-F.col("b.c")).alias("confidence"))


def variant_matrix(variants: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """expected, present, missing counts of axis combinations per group, from distinct values of each axis."""
    sizes = [F.countDistinct(a) for a in axes]
    expected = sizes[0]
    for s in sizes[1:]:
        expected = expected * s
    out = variants.groupBy(*by).agg(expected.alias("expected"), F.countDistinct(*axes).alias("present"))
    return out.withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("present")))


def reconcile_pairs(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, value, attribution (a, b, neither) of the fields of two sides (by, value, confidence, ts), one row a key on each.

    The side that has a value wins, of two the more confident, then the newer, then a; null confidences are the least.
    """
    x, y = (side.select(F.struct(*by).alias("_key"), F.struct("value", F.coalesce("confidence", F.lit(float("-inf"))).alias("c"), "ts").alias(name)) for side, name in ((a, "a"), (b, "b")))
    both = x.join(y, "_key", "full")
    better = (F.col("a.c") > F.col("b.c")) | ((F.col("a.c") == F.col("b.c")) & (F.coalesce(F.col("a.ts") >= F.col("b.ts"), F.col("b.ts").isNull())))
    won = F.when(F.col("a.value").isNull(), F.when(F.col("b.value").isNull(), "neither").otherwise("b")).when(F.col("b.value").isNull() | better, "a").otherwise("b")
    return both.select("_key.*", F.when(won == "a", F.col("a.value")).otherwise(F.col("b.value")).alias("value"), won.alias("attribution"))


def missing_variants(variants: DataFrame, by: list[str], axes: list[str], step: int = 10_000) -> DataFrame:
    """by, axes: the combinations of a group's axis values that no variant has, in order of the axes' values.

    A combination's rank is a number in mixed radix: the ranks that are there leave gaps, and only what is in the gaps is
    enumerated, `step` at a time, so the product of the axes is never held. As many are given as the group has fewer rows than
    combinations, the first ones: rows that repeat a combination, or have none, may stand for one that isn't known. An axis
    without any value takes no part (null); a group in which no axis has one lacks nothing.
    """
    key = F.struct(*by)
    groups = variants.groupBy(key.alias("_key")).agg(F.count("*").alias("_actual"), *[F.array_sort(F.collect_set(a)).alias(f"_{a}") for a in axes])
    size = lambda a: F.greatest(F.size(f"_{a}"), F.lit(1)).cast("long")
    strides = {}
    stride = F.lit(1).cast("long")
    for a in reversed(axes):
        strides[a], stride = stride, stride * size(a)
    groups = groups.withColumn("_all", F.when(F.greatest(*[F.size(f"_{a}") for a in axes], F.lit(0)) > 0, stride).otherwise(0)) if len(axes) else groups
    place = lambda a: F.when(F.size(f"_{a}") == 0, 0).otherwise(F.array_position(f"_{a}", F.col(a)) - 1)
    rank = F.lit(0).cast("long")
    for a in axes:
        rank = rank + place(a) * strides[a]
    there = variants.select(key.alias("_key"), *axes).distinct().join(groups, "_key").withColumn("_rank", rank).filter("_rank is not null and _all > 0").select("_key", "_rank")
    # each rank and the end of the group close a gap
    closed = there.withColumn("_to", F.col("_rank")).unionByName(groups.select("_key", F.lit(None).cast("long").alias("_rank"), F.col("_all").alias("_to")))
    order = Window.partitionBy("_key").orderBy("_to", F.col("_rank").isNull())
    gaps = closed.withColumn("_from", F.coalesce(F.lag("_to").over(order) + 1, F.lit(0))).withColumn("_before", F.row_number().over(order) - 1)
    gaps = gaps.join(groups, "_key").withColumn("_last", F.least(F.col("_to"), F.col("_before") + F.greatest(F.col("_all") - F.col("_actual"), F.lit(0))) - 1).filter("_from <= _last")
    starts = gaps.withColumn("_start", F.explode(F.sequence("_from", "_last", F.lit(step).cast("long"))))
    each = starts.withColumn("_n", F.explode(F.sequence("_start", F.least(F.col("_start") + step - 1, F.col("_last")))))
    value = lambda a: F.get(f"_{a}", (F.call_function("div", F.col("_n"), strides[a]) % size(a)).cast("int"))
    return each.select("_key.*", *[value(a).alias(a) for a in axes])
