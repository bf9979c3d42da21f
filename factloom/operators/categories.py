"""Category of a product by the words of known category paths.

Every way in which a path can fit becomes a key of an index: its leaf, its segments, their parts, and the first word of
each segment. A product brings forth its own keys, and the two meet by equality, whatever the number of paths;
only segments that are to be found in a title are checked again at the place. The best rule and the first path are a
minimum, which is taken per product before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence by rule: the type is a leaf, part of a segment or the other way round, a segment is a word of the title, a tag.
CONFIDENCE = {1: 0.85, 2: 0.75, 3: 0.65, 4: 0.60}
#: Letters of a segment that a title is searched for, at least.
TITLE_LETTERS = 4


def plain(text: Column) -> Column:
    """Lower-cased and trimmed, - and _ being spaces."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), "[-_]", " ")


def contains_word(text: Column, word: Column) -> Column:
    """Whether text has word between its ends or characters other than A-Z, a-z, 0-9 and _; words are taken literally."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.rlike(text, F.concat(F.lit(r"(^|\W)"), quoted, F.lit(r"(\W|$)")))


def parts(text: Column, lengths: Column) -> Column:
    """Distinct parts of text that have one of the lengths."""
    each = F.transform(lengths, lambda n: F.when(n <= F.char_length(text), F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(each))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\W+"), lambda w: w != ""))


def path_index(paths: DataFrame) -> DataFrame:
    """rule, key, segment (of rule 3), ordinal, path from paths (ordinal, path), for each key the first path."""
    split = F.filter(F.transform(F.split(F.lower("path"), "/"), F.trim), lambda s: s != "")
    all_ = paths.filter("path is not null").select("ordinal", "path", split.alias("segments"), F.trim(F.element_at(F.split(F.lower("path"), "/"), -1)).alias("leaf"))
    segments = all_.select("ordinal", "path", F.explode("segments").alias("s"))
    none, s = F.lit(None).cast("string"), F.col("s")
    key = lambda df, rule, k, segment=none: df.select(F.lit(rule).alias("rule"), k.alias("key"), segment.alias("segment"), "ordinal", "path")
    first = F.coalesce(F.get(words(s), F.lit(0)), F.lit(""))
    keys = [
        key(all_.filter("leaf <> ''"), 1, F.col("leaf")),
        key(segments, 2, F.explode(parts(s, F.sequence(F.lit(1), F.char_length(s))))),  # the type is a part of a segment
        key(segments, 5, s),  # a segment is a part of the type
        key(segments.filter(F.char_length(s) >= TITLE_LETTERS), 3, first, s),
        key(segments, 4, s),
    ]
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return out.groupBy("rule", "key", "segment").agg(F.min(F.struct("ordinal", "path")).alias("first")).select("rule", "key", "segment", "first.ordinal", "first.path")


def detect_categories(products: DataFrame, paths: DataFrame) -> DataFrame:
    """id, title, type, tags of products, a row for each that differs, with path and confidence.

    paths: ordinal, path; segments are separated by /. The first rule that fits counts, and within it the first path by ordinal:
    the type is a path's last segment (.85); it is a part of a segment, or a segment of it (.75); a segment of four letters
    or more is a word of the title, or several in turn (.65); the first of the tags that is a segment (.60). Types, titles
    and tags are compared in lower case, trimmed, with spaces for - and _; segments in lower case, trimmed. Null and empty
    ones fit nothing, and no path at all gives a null path and 0. Columns other than these aren't read.
    """
    products = products.select("id", "title", "type", "tags")
    # what is asked of the index doesn't depend on ids: equal titles, types and tags are asked once
    said = ["title", "type", "tags"]
    contents = products.select(*said).distinct()
    index = path_index(paths)
    lengths = index.filter("rule = 5").agg(F.sort_array(F.collect_set(F.char_length("key")))).head()[0]  # lengths of segments: few
    type_, title = plain(F.col("type")), plain(F.col("title"))
    cand = lambda rule, pos, key: F.struct(F.lit(rule).alias("rule"), pos.cast("int").alias("pos"), key.alias("key"))
    each = lambda rule, keys: F.transform(keys, lambda k: cand(rule, F.lit(0), k))
    none = F.array().cast("array<struct<rule:int,pos:int,key:string>>")
    typed = F.when(type_ != "", F.concat(F.array(cand(1, F.lit(0), type_), cand(2, F.lit(0), type_)), each(5, parts(type_, F.lit(lengths).cast("array<int>"))))).otherwise(none)
    titled = F.when(title != "", each(3, F.concat(words(title), F.array(F.lit(""))))).otherwise(none)
    tagged = F.coalesce(F.filter(F.transform("tags", lambda t, i: cand(4, i, plain(t))), lambda c: c["key"] != ""), none)
    asked = contents.select("*", title.alias("_title"), F.explode(F.concat(typed, titled, tagged)).alias("c"))
    asked = asked.select(*said, F.when(F.col("c.rule") == 3, F.col("_title")).alias("_title"), F.col("c.rule").alias("_rule"), F.col("c.key").alias("_key"), F.col("c.pos").alias("_pos"))
    met = asked.join(index, (F.col("_rule") == F.col("rule")) & (F.col("_key") == F.col("key")) & ((F.col("rule") != 3) | contains_word(F.col("_title"), F.col("segment"))))
    rule = F.when(F.col("rule") == 5, 2).otherwise(F.col("rule"))
    found = met.groupBy(F.struct(*said).alias("_said")).agg(F.min(F.struct(rule.alias("rule"), "_pos", "ordinal", "path")).alias("b"))
    best = products.distinct().withColumn("_said", F.struct(*said)).join(found, "_said", "left")
    confidence = F.coalesce(*[F.when(F.col("b.rule") == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(0.0))
    return best.select("id", "title", "type", "tags", F.col("b.path").alias("path"), confidence.alias("confidence"))
