"""Substring dedup over documents: passages that a document of a smaller doc_id has too go, the first stays.

A word is removed if it is in a window of `length` words that also starts in a document of a smaller doc_id. Hashing
every window would send a row for each word of the corpus; a difference cover needs a fraction of them:

1. Anchors: the K-word strings that start at positions which are, modulo a period v, in a difference cover. For any two
   positions i and j there is a step under v that takes both to the cover at once, so two equal windows of K + v - 1 words
   have an anchor in common, at the same place in both, wherever in their documents they are.
2. Extension: with its anchor goes a hash of all that the windows around it can reach, v - 1 words to the left and `length`
   from its start on, as far as the document goes. Of anchors that agree in that, all but the least document's are
   later copies with everything around; a task tells that for its own rows before it sends anything on.
3. What is left are anchors that distinct surroundings have in common. They alone are extended word by word: the windows
   around them are compared as wholes, and those of the least document stay.
   An anchor that very many surroundings of one task share isn't sent: its windows are, and a mark to all others of its kind.
4. Each document gets its runs of words and is cut.

Anchors only say where to look. Surroundings are equal if the hash of the anchor and one of another function over all words
are; windows if two hashes of 61 bits are; what a task compares among its own FLUSH_BYTES, if 64 bits made of both are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import deleted, partitions, table, written
from factloom.llm.words import SPACE, U, blocks, flat_bytes, mix, prefix_hash, slice_hash, word_bounds

LENGTH = 50
#: Perfect difference covers, by their period: every difference modulo the period is one of two members (fixed values).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Bytes of text that are hashed at once; bytes and rows that a task compares with each other before it sends them on.
CHUNK, FLUSH_BYTES, FLUSH = 1 << 20, 4 << 20, 400_000
#: Surroundings of an anchor that a task sends for each FLUSH_BYTES; of more it sends the windows.
MOST = 16
#: Kinds of rows: a run of words that go, an anchor's surroundings, a window, a mark that an anchor has more.
RUN, AROUND, WINDOW, MARK = range(4)
#: Other values of bytes, for a second hash that doesn't depend on the first.
OTHER = np.random.default_rng(97).permutation(256).astype(np.uint8)
NAMES = ["kind", "k1", "k2", "doc_id", "start", "end"]
KINDS = "kind byte, k1 long, k2 long, doc_id long, start int, end int"


@dataclass(frozen=True)
class Cover:
    """Windows of `length` words and the difference cover their anchors of `anchor` words start in."""

    length: int
    period: int
    members: tuple[int, ...]

    @property
    def anchor(self) -> int:
        return self.length - self.period + 1

    @staticmethod
    def of(length: int) -> Cover:
        if length < 8:
            raise ValueError("windows of 8 words at least")
        period = max(v for v in COVERS if v == min(COVERS) or 3 * v <= 2 * length)
        return Cover(length, period, COVERS[period])


@dataclass
class Block:
    """Words of some texts, or of a piece of one, joined by single spaces; arrays with an entry for each word."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # number of its text
    index: np.ndarray  # of the word in its text
    n: np.ndarray  # words of each text
    own: slice  # words whose anchors are this block's

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return prefix_hash(self.data), prefix_hash(OTHER[self.data])


def joined_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words of the texts, a space after each, start and end of each word, and the n + 1 first words of texts."""
    data, starts = flat_bytes(texts)
    begin, end, first = word_bounds(data, starts)
    gap = SPACE[data]
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    data = np.where(gap, np.uint8(32), data)[keep]
    size = end - begin
    end = np.cumsum(size + 1) - 1
    return data, end - size, end, first


def blocks_of(texts: pa.Array, cover: Cover) -> Iterator[Block]:
    """The texts as one block, or a single long one in pieces that have all that their anchors can reach."""
    data, begin, end, first = joined_words(texts)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    index = np.arange(len(begin)) - first[doc]
    if len(data) <= 2 * CHUNK or len(n) > 1:
        yield Block(data, begin, end, doc, index, n, slice(0, len(begin)))
        return
    step = CHUNK // 8
    for lo in range(0, len(begin), step):
        a, b = max(0, lo - cover.period + 1), min(len(begin), lo + step + cover.length)
        yield Block(data[begin[a] : end[b - 1]], begin[a:b] - begin[a], end[a:b] - begin[a], doc[a:b], index[a:b], n, slice(lo - a, min(lo + step, len(begin)) - a))


def anchors_of(block: Block, cover: Cover) -> tuple[np.ndarray, ...]:
    """Anchor's hash (even), surroundings' hash, first word of these in the block and number of words, for each anchor."""
    member = np.zeros(cover.period, bool)
    member[list(cover.members)] = True
    at = np.arange(block.own.start, block.own.stop)
    n, i = block.n[block.doc[at]], block.index[at]
    some = member[i % cover.period] & (i + cover.anchor <= n) & (n >= cover.length)
    at, n, i = at[some], n[some], i[some]
    left = np.minimum(i, cover.period - 1)
    right = np.minimum(n - i, cover.length)
    one, two = block.sums()
    anchor = slice_hash(one, block.begin[at], block.end[at + cover.anchor - 1])
    around = slice_hash(two, block.begin[at - left], block.end[at + right - 1])
    return anchor & ~U(1), mix(around + left.astype(U)), at - left, left + right


def windows_of(block: Block, start: np.ndarray, cover: Cover) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window that starts at a word of the block."""
    last = start + cover.length - 1
    one, two = (slice_hash(s, block.begin[start], block.end[last]) for s in block.sums())
    return one | U(1), two


def spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1 ... start[i] + many[i] - 1 for each i."""
    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ranges of documents."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by], end[by]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    # ends are made to rise over all documents, so that one running maximum does for each
    lift = (np.cumsum(new) - 1) << 40
    reach = np.maximum.accumulate(end + lift)
    cut = np.flatnonzero(np.concatenate([[True], start[1:] + lift[1:] > reach[:-1]]))
    last = np.concatenate([cut[1:], [len(doc)]]) - 1
    return doc[cut], start[cut], (reach - lift)[last]


def firsts(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document that has each row's key."""
    _, of = np.unique(key, return_inverse=True)
    least = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc)
    return least[of]


def rows(kind: int, k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    cols = [np.full(len(doc), kind, np.int8), k1.view(np.int64), k2.view(np.int64), doc, start.astype(np.int32), end.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], NAMES)


def run_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    doc, start, end = merged(doc, start, end)
    key = mix(doc.view(U) ^ mix(start.astype(U))) | U(1)  # deals them out
    return rows(RUN, key, key, doc, start, end)


def window_rows(found: list[tuple[np.ndarray, ...]], length: int) -> Iterator[pa.RecordBatch]:
    """Windows (two hashes, document, start) that a task has, each of the least document; the others are runs that go."""
    k1, k2, doc, start = (np.concatenate(c) for c in zip(*found, strict=True))
    least = firsts(k1 ^ mix(k2), doc)
    late = doc > least
    yield run_rows(doc[late], start[late], start[late] + length)
    yield rows(WINDOW, k1[~late], k2[~late], doc[~late], start[~late], start[~late] + length)


def around_rows(docs: DataFrame, cover: Cover) -> DataFrame:
    """Rows of NAMES for docs (doc_id, text): of what a task sees, surroundings of the least documents, runs of the others."""
    most = MOST

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, around, doc, start, many = (np.concatenate(c) for c in list(zip(*held, strict=True))[:5])
        late = doc > firsts(around ^ mix(anchor), doc)
        yield run_rows(doc[late], start[late], start[late] + many[late])
        lead = np.flatnonzero(~late)
        _, of = np.unique(anchor[lead], return_inverse=True)
        hot = (np.bincount(of) > most)[of] if len(lead) else np.zeros(0, bool)
        cold = lead[~hot]
        yield rows(AROUND, anchor[cold], around[cold], doc[cold], start[cold], start[cold] + many[cold])
        if not hot.any():
            return
        marks = np.unique(anchor[lead[hot]])
        none = np.zeros(len(marks), np.int64)
        yield rows(MARK, marks, none.view(U), none, none, none)
        is_hot, found, at = np.zeros(len(anchor), bool), [], 0
        is_hot[lead[hot]] = True
        for a, _, d, s, m, block, first in held:
            mine = is_hot[at : at + len(a)]
            at += len(a)
            if mine.any():
                # the windows of all surroundings, each once
                window = np.unique(spread(first[mine], m[mine] - cover.length + 1))
                ids = np.zeros(len(block.doc), np.int64)
                ids[spread(first[mine], m[mine])] = np.repeat(d[mine], m[mine])
                found.append((*windows_of(block, window, cover), ids[window], block.index[window]))
        yield from window_rows(found, cover.length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for part in blocks(batch, limit=CHUNK):
                ids = part.column(0).to_numpy()
                new = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], bool)
                if not new.all():  # a repeated row
                    part, ids = part.filter(pa.array(new)), ids[new]
                for block in blocks_of(part.column(1), cover):
                    anchor, around, first, many = anchors_of(block, cover)
                    held.append((anchor, around, ids[block.doc[first]], block.index[first], many, block, first))
                    size += len(block.data)
                    if size > FLUSH_BYTES:
                        yield from out(held)
                        held, size, seen = [], 0, set()
        if held:
            yield from out(held)

    return docs.select("doc_id", "text").mapInArrow(run, KINDS)


def whole_groups(batches: Iterable[pa.RecordBatch], least: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by k1, some `least` rows at a time, all rows of a k1 together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        cols = [pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(batch.num_columns)]
        cut = int(np.searchsorted(cols[1], cols[1][-1]))  # the last k1 may go on
        if cut:
            yield [c[:cut] for c in cols]
        held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in cols], batch.schema.names)]
        n -= cut
    if n:
        yield [pa.chunked_array([b.column(i) for b in held]).to_numpy() for i in range(held[0].num_columns)]


def judged(dealt: DataFrame) -> DataFrame:
    """Rows of NAMES: runs that go, surroundings that are to be extended, and windows, of rows of all tasks.

    Surroundings and windows of which a lesser document has equals go as runs; surroundings stay that share their anchor
    with others, and runs and windows of anchors with a mark pass.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, k1, k2, doc, start, end in whole_groups(batches):
            new_key = np.concatenate([[True], k1[1:] != k1[:-1]])
            new = new_key | np.concatenate([[True], k2[1:] != k2[:-1]])
            first = np.flatnonzero(new)
            least = doc[first][np.cumsum(new) - 1]
            late = ((kind == AROUND) | (kind == WINDOW)) & (doc > least)
            yield run_rows(np.concatenate([doc[late], doc[kind == RUN]]), *(np.concatenate([c[late], c[kind == RUN]]).astype(np.int64) for c in (start, end)))
            group = np.cumsum(new_key) - 1
            low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
            led = first[kind[first] == AROUND]
            np.minimum.at(low, group[led], doc[led])
            np.maximum.at(high, group[led], doc[led])
            marked = np.zeros(group[-1] + 1, bool)
            marked[group[kind == MARK]] = True
            keep = ~late & ((kind == AROUND) & (marked | (low < high))[group] | (kind == WINDOW))
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (kind, k1, k2, doc, start, end)], NAMES)

    keyed = dealt.repartition(partitions(dealt.sparkSession), "k1").sortWithinPartitions("k1", "k2", "doc_id")
    return keyed.select(*NAMES).mapInArrow(run, KINDS)


def extended(docs: DataFrame, around: DataFrame, cover: Cover) -> DataFrame:
    """Rows of NAMES, windows and runs, of the surroundings (doc_id, start, end) in docs (doc_id, text)."""
    lists = around.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in blocks(batch, limit=CHUNK):
                ids = part.column(0).to_numpy()
                spans = part.column(1)
                of = np.repeat(np.arange(part.num_rows), np.asarray(spans.value_lengths()))
                start, end = (spans.flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
                for block in blocks_of(part.column(2), cover):
                    if not len(block.doc):
                        continue
                    # a word's place in the block is its index and what its text is shifted by
                    shift = np.zeros(part.num_rows, np.int64)
                    shift[block.doc] = np.arange(len(block.doc)) - block.index
                    low, high = (np.zeros(part.num_rows, np.int64) for _ in range(2))
                    low[block.doc[::-1]] = block.index[::-1]
                    high[block.doc] = block.index + 1
                    a, b = np.maximum(start, low[of]), np.minimum(end, high[of]) - cover.length + 1
                    some = a < b
                    window = np.unique(spread((a + shift[of])[some], (b - a)[some]))
                    if not len(window):
                        continue
                    found.append((*windows_of(block, window, cover), ids[block.doc[window]], block.index[window]))
                    size += len(window)
                    if size > FLUSH:
                        yield from window_rows(found, cover.length)
                        found, size = [], 0
        if found:
            yield from window_rows(found, cover.length)

    return docs.join(lists.hint("merge"), "doc_id").select("doc_id", "spans", "text").mapInArrow(run, KINDS)


def shared_runs(docs: DataFrame, cover: Cover) -> DataFrame:
    """doc_id, runs (start << 32 | end in words, in any order, may overlap) of the documents that lose a part."""
    first = written(judged(around_rows(docs, cover)), "around")
    more = written(extended(docs, first.filter(F.col("kind") == AROUND), cover), "windows")
    windows = first.filter(F.col("kind") == WINDOW).unionByName(more.filter(F.col("kind") == WINDOW))
    runs = first.filter(F.col("kind") == RUN).unionByName(more.filter(F.col("kind") == RUN)).unionByName(judged(windows).filter(F.col("kind") == RUN))
    packed = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    out = written(runs.select("doc_id", packed.alias("run")).groupBy("doc_id").agg(F.collect_list("run").alias("runs")), "runs")
    deleted(first, more)
    return out


def remove_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs' rows with n_words, removed_spans (start, end of each maximal run, in words) and kept_text, the other words.

    docs: doc_id (long), text; a word is a run of characters other than space and \\x09-\\x0D, as it is; kept words are joined
    by one space. Null texts and texts under `length` words lose nothing; windows never cross documents, and a passage
    that only one document has, however often, stays. Rows of equal doc_id and text are one document and get the
    same answer. Of rows that share a doc_id but not the text, the one of the least SHA-256 is the document; the others,
    and rows of a null doc_id, lose nothing and are nobody's earlier document. An empty table stays empty. Other columns are
    kept, but for ones named n_words, removed_spans or kept_text.
    """
    cover = Cover.of(length)
    docs = docs.drop("n_words", "removed_spans", "kept_text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # helper names don't meet the table's
    docs = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("_")).alias("rest"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    digests = docs.filter("doc_id is not null").select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    clash = written(digests.filter("least <> most").select("doc_id", "least"), "clashes")
    ours = docs.withColumn("ours", F.col("doc_id").isNotNull())
    if not clash.isEmpty():
        ours = docs.join(clash, "doc_id", "left").withColumn("ours", F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("least") == digest))).drop("least")
    runs = shared_runs(ours.filter("ours").select("doc_id", "text"), cover)
    joined = ours.join(runs.hint("merge"), "doc_id", "left").select("doc_id", "rest", F.when(F.col("ours"), F.col("runs")).alias("runs"), "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                data, begin, end, first = joined_words(part.column(3))
                runs = part.column(2)
                many = np.where(np.asarray(runs.is_valid()), np.nan_to_num(runs.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
                packed = runs.flatten().to_numpy()
                doc, start, stop = merged(np.repeat(np.arange(part.num_rows), many), packed >> 32, packed & 0xFFFFFFFF)
                gone = np.zeros(len(begin), bool)
                gone[spread(first[doc] + start, stop - start)] = True
                size = np.where(gone, 0, end - begin + 1)  # with the space after it
                upto = np.concatenate([[0], np.cumsum(size)])[first]
                kept = data[~np.repeat(gone, end - begin + 1)] if len(data) else data
                text = [kept[a : max(a, b - 1)].tobytes().decode() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], ["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(np.diff(first)), spans, pa.array(text, pa.string())], ["doc_id", "rest", "text", "n_words", "removed_spans", "kept_text"])

    kind = joined.schema["rest"].dataType.simpleString()
    done = joined.mapInArrow(cut, f"doc_id long, rest {kind}, text string, n_words long, removed_spans array<struct<start:long,end:long>>, kept_text string")
    return done.select("doc_id", "text", *(F.col(f"rest.`{c}`").alias(c) for c in others), "n_words", "removed_spans", "kept_text")


def op13_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op13_passage_dedup": op13_passage_dedup}
ORACLES = {
    "op13_passage_dedup": f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    w AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) + 1)) AS p, words FROM d),
    windows AS (SELECT doc_id, p, array_to_string(words[p:p + {LENGTH - 1}], ' ') AS s FROM w WHERE p + {LENGTH - 1} <= n),
    firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
    late AS (SELECT doc_id, p FROM windows JOIN firsts USING (s) WHERE least < doc_id),
    marked AS (
      SELECT w.doc_id, w.p, words[w.p] AS word, coalesce(w.p - max(late.p) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS UNBOUNDED PRECEDING) < {LENGTH}, false) AS gone
      FROM w LEFT JOIN late ON late.doc_id = w.doc_id AND late.p = w.p),
    kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """
}
