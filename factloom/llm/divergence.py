"""Quality rules: base statistics of a text, and its divergence from its language.

References are made from all documents: for each language, the shares of character classes and of its
most common words, counted exactly. A document's own histograms are compared with its language's by the
Jensen-Shannon distance. A short text's histogram says little, so the distance has to exceed a bound that also allows
for the distance chance gives a text of its length; below a least length the verdict is the base rules'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table, written
from factloom.llm.words import SPACE, U, blocks, flat_bytes, mix, prefix_hash, shingle_hash, slice_hash, word_bounds, word_ids

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Lengths below which histograms aren't compared: of a document, and of a language's reference.
GUARD_CHARS, GUARD_WORDS, GUARD_REFERENCE = 100, 20, 5000
COMMON_WORDS = 40
#: Bytes of text whose words are counted at once, and languages whose classes a task sums before it sends them on.
COUNTED_BYTES, HELD_LANGUAGES = 2 << 20, 30_000
#: References that are shipped with the code: under 5 MB.
REFERENCES, LANG_BYTES = 1000, 256
CHAR_LIMIT, WORD_LIMIT = 0.2, 0.5
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "bracket", "letter beyond ASCII", "other")
SYMBOLS = b"#*$%&|<>"

CLASS = np.full(256, 9, np.uint8)
CLASS[ord("a") : ord("z") + 1] = 0
CLASS[ord("A") : ord("Z") + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[[9, 11, 12, 13, 32]] = 3
CLASS[10] = 4
CLASS[list(b".,;:!?'\"-")] = 5
CLASS[list(SYMBOLS + b"@^~`_=+\\/{}")] = 6
CLASS[list(b"()[]")] = 7
CLASS[0xC3:0xDC] = 8
CLASS[0x80:0xC0] = 10  # the rest of a character, not counted
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True


def per_text(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set flags of each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[starts[1:] - 1] - sums[starts[:-1]]


def repeats(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of texts in turn: whether another item of its text is equal, and whether an earlier one is."""
    key = mix(hashes + owner.astype(U) * U(0xC2B2AE3D27D4EB4F))
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[by[1:]] = same
    any_[by[1:]] = same
    any_[by[:-1]] |= same
    return any_, later


def class_counts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Characters of each class in each text of a block from flat_bytes."""
    n = len(starts) - 1
    doc = np.repeat(np.arange(n), np.diff(starts))
    out = np.bincount(doc * 16 + CLASS[data], minlength=n * 16).reshape(n, 16)[:, : len(CLASSES)]
    out[:, 3] -= 1  # the space after a text
    return out


class Counted:
    """Statistics of a block of texts; arrays with an entry for each."""

    def __init__(self, texts: pa.Array):
        data, starts = flat_bytes(texts)
        self.n = n = len(starts) - 1
        doc = np.repeat(np.arange(n), np.diff(starts))
        sums = prefix_hash(data)
        begin, end, first = word_bounds(data, starts)
        self.words, self.first, self.owner = slice_hash(sums, begin, end), first, doc[begin]
        self.n_words = np.diff(first)
        chars = (data & 0xC0) != 0x80
        self.word_chars = per_text(chars & ~SPACE[data], starts)
        self.n_symbols = per_text(IS_SYMBOL[data], starts)
        self.classes = class_counts(data, starts)
        kept = np.ones(len(data), bool)
        kept[starts[1:] - 1] = False
        # lines that hold a word
        stop = np.flatnonzero((data == 10) | ~kept)
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        full = np.searchsorted(begin, stop) > np.searchsorted(begin, start)
        start, stop = start[full], stop[full]
        self.n_dup_lines = np.bincount(doc[start][repeats(doc[start], slice_hash(sums, start, stop))[1]], minlength=n)
        # words in 5-word windows that are in the text twice
        covered = np.zeros(len(self.words) + 1, np.int64)
        five = shingle_hash(self.words, 5)
        at = np.flatnonzero(self.owner[: len(five)] == self.owner[4:]) if len(five) else np.zeros(0, np.int64)
        hit = at[repeats(self.owner[at], five[at])[0]] if len(at) else at
        np.add.at(covered, hit, 1)
        np.subtract.at(covered, hit + 5, 1) if len(hit) else None
        self.n_repeat_words = np.bincount(self.owner[np.cumsum(covered)[:-1] > 0], minlength=n)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of the rows of p and q, which sum to 1 each or are 0."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1)
        return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def word_key(word: bytes) -> bytes:
    """A word itself, or of one of 64 bytes or more its SHA-256 in hexadecimal."""
    return word if len(word) < 64 else hashlib.sha256(word).hexdigest().encode()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (its key), hash (that of Counted), n of docs (lang, text), summed over a few MB of texts each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=COUNTED_BYTES, most=1 << 16):
                data, starts = flat_bytes(part.column(1))
                begin, end, first = word_bounds(data, starts)
                if not len(begin):
                    continue
                langs = part.column(0).dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(first))
                hashes = slice_hash(prefix_hash(data), begin, end)
                ids = word_ids(data, begin, end, hashes)
                _, at, n = np.unique(lang * (int(ids.max()) + 1) + ids, return_index=True, return_counts=True)
                size = (end - begin)[at]
                for some, short in ((size < 64, True), (size >= 64, False)):
                    a, m = at[some], size[some]
                    if not len(a):
                        continue
                    if short:
                        upto = np.cumsum(m)
                        raw = data[np.repeat(begin[a] - (upto - m), m) + np.arange(upto[-1])]
                        offsets = np.concatenate([[0], upto]).astype(np.int32)
                        word = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                    else:
                        word = pa.array([word_key(data[x : x + k].tobytes()) for x, k in zip(begin[a].tolist(), m.tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[a])), word, pa.array(hashes[a].view(np.int64)), pa.array(n[some])], ["lang", "word", "hash", "n"])

    return docs.mapInArrow(run, "lang string, word binary, hash long, n long")


def references(docs: DataFrame) -> DataFrame:
    """lang, classes, n_words, words, hashes, counts: a row for each language of docs (text, lang) with GUARD_REFERENCE words.

    classes are the counts of character classes, words the keys of the COMMON_WORDS most frequent words, ties by
    bytes, hashes and counts theirs. All documents are counted, and exactly, so partitioning changes nothing.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    words = written(word_counts(docs).groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "word-counts")
    enough = words.groupBy("lang").agg(F.sum("n").alias("n_words")).filter(F.col("n_words") >= GUARD_REFERENCE)
    # the most frequent of each salted part first, so that no task gets a language's whole vocabulary
    salted = words.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(64)))
    for keys in (["lang", "salt"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))
        salted = salted.withColumn("nth", nth).filter(F.col("nth") <= COMMON_WORDS)
    common = salted.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("nth", "word", "hash", "n"))).alias("top"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            cols = [pa.array(held, pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, ["lang", "classes"])

        for batch in batches:
            for part in blocks(batch):
                data, starts = flat_bytes(part.column(1))
                langs = part.column(0).dictionary_encode()
                total = np.zeros((len(langs.dictionary), len(CLASSES)), np.int64)
                np.add.at(total, langs.indices.to_numpy(), class_counts(data, starts))
                for x, row in zip(langs.dictionary.to_pylist(), total, strict=True):
                    held[x] = held[x] + row if x in held else row
                if len(held) > HELD_LANGUAGES:
                    yield out()
                    held.clear()
        yield out()

    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    classes = docs.mapInArrow(count, "lang string, classes array<bigint>").groupBy("lang").agg(*sums)
    classes = classes.select("lang", F.array(*(f"c{i}" for i in range(len(CLASSES)))).alias("classes"))
    joined = enough.join(common, "lang").join(classes, "lang")
    return joined.select("lang", "classes", "n_words", F.col("top.word").alias("words"), F.col("top.hash").alias("hashes"), F.col("top.n").alias("counts"))


class Reference:
    """A language's shares of character classes and of its common words, and the hashes of these words."""

    def __init__(self, classes: list[int], n_words: int, words: list[bytes], hashes: list[int], counts: list[int]):
        self.classes = np.array(classes, float) / max(1, sum(classes))
        common = np.array(hashes, np.int64).view(U)
        by = np.argsort(common)
        share = np.array(counts, float)[by] / n_words
        self.common, self.share = common[by], np.append(share, max(0.0, 1 - share.sum()))


def judge(docs: DataFrame, refs: DataFrame | None = None, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept for each row of docs (doc_id, text, lang).

    base_failed: fewer than MIN_WORDS words, or over MAX_REPEAT_PERCENT of the words repeat in 5-word
    windows. kept: not base_failed, and no distance over its limit; distances are null, and say nothing,
    for texts under the guards and languages with few words. Limits grow by 1 / sqrt(length) for short texts.
    Null and empty texts have zeros and fail. A null lang is a language of its own. Rows are judged one by
    one, so repeated ones alike; other columns are not read. refs: those of `references`, of docs if None.

    References go to tasks with the code up to REFERENCES languages of up to LANG_BYTES; that takes 5,000 words
    of each, so there are more only where the column isn't languages, and then they are joined to the rows.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    refs = written(references(docs) if refs is None else refs, "references")
    kind = docs.schema["doc_id"].dataType.simpleString()
    few = refs.filter(F.octet_length("lang") > LANG_BYTES).isEmpty() and refs.limit(REFERENCES + 1).count() <= REFERENCES
    known = {r["lang"]: Reference(*r[1:]) for r in refs.collect()} if few else {}
    if not few:
        docs = docs.join(refs.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"), "left").select(*docs.columns, "classes", "n_words", "words", "hashes", "counts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                c, langs = Counted(part.column(2)), part.column(1).dictionary_encode()
                lang, first = langs.indices.to_numpy(), np.unique(langs.indices.to_numpy(), return_index=True)[1]
                chars = c.classes.sum(axis=1)
                char_d, word_d = np.full(c.n, np.nan), np.full(c.n, np.nan)
                by = np.argsort(lang, kind="stable")
                upto = np.searchsorted(lang[by], np.arange(len(first) + 1))
                number = np.empty(c.n, np.int64)
                number[by] = np.arange(c.n) - upto[lang[by]]
                words = np.argsort(lang[c.owner], kind="stable")
                w_upto = np.searchsorted(lang[c.owner][words], np.arange(len(first) + 1))
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    mine, rows = by[upto[k] : upto[k + 1]], words[w_upto[k] : w_upto[k + 1]]
                    ref = known.get(name)
                    if not few and part.column(3)[first[k]].is_valid:
                        ref = Reference(*(part.column(i)[first[k]].as_py() for i in range(3, 8)))
                    if ref is None:
                        continue
                    p = c.classes[mine] / np.maximum(chars[mine], 1)[:, None]
                    char_d[mine] = np.where(chars[mine] >= GUARD_CHARS, distance(p, np.broadcast_to(ref.classes, p.shape)), np.nan)
                    n = len(ref.common)
                    at = np.minimum(np.searchsorted(ref.common, c.words[rows]), n - 1)
                    slot = np.where(ref.common[at] == c.words[rows], at, n)
                    h = np.bincount(number[c.owner[rows]] * (n + 1) + slot, minlength=len(mine) * (n + 1)).reshape(len(mine), n + 1)
                    h = h / np.maximum(c.n_words[mine], 1)[:, None]
                    word_d[mine] = np.where(c.n_words[mine] >= GUARD_WORDS, distance(h, np.broadcast_to(ref.share, h.shape)), np.nan)
                failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEAT_PERCENT * c.n_words)
                far = (char_d > char_limit + 1 / np.sqrt(np.maximum(chars, 1))) | (word_d > word_limit + 1 / np.sqrt(np.maximum(c.n_words, 1)))
                cols = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v.astype(np.int64)) for v in cols], pa.array(failed), pa.array(char_d, mask=np.isnan(char_d)), pa.array(word_d, mask=np.isnan(word_d)), pa.array(~failed & ~far)], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean")


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op3_divergence": op3_divergence}
