"""Suffix-array dedup: later copies of long byte strings go, the first copy stays.

A byte is removed if it is in a string of `length` bytes that also starts earlier, in a document of a
smaller doc_id or earlier in the same one. In terms of suffixes in order: position i starts a later copy
if its longest previous factor is `length` or more, and the longest previous factor is the longer common
prefix with the previous or the next smaller position in suffix order.

Sorting all suffixes of a corpus isn't needed for that; most have no partner. So:
1. Anchors: in each window of `length` bytes, the K-byte string of least hash, leftmost, is its anchor.
   Equal windows have equal anchors at the same place, so windows meet their copies at their anchor.
   The windows with the same anchor occurrence are neighbours and form a segment.
2. Segments equal to an earlier one are later copies as a whole, and nothing is to be sorted for them. A map
   task compares segments byte by byte and sends only the first of equal ones on; those of different tasks
   are equal if hash and anchor are.
3. What is left are first segments whose anchor's K bytes also occur in other segments. Their suffixes
   are brought in order together, by prefix doubling, in a task for many anchors; previous and next smaller
   positions, by a stack, give the longest previous factors. Of an anchor with very many segments only the
   windows take part that occur in more than one task, again once for each task, and each window is a group of its
   own: suffixes that agree in all its bytes, a row for each task at most.
4. Each document gets its runs and is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import deleted, partitions, scratch, table, written
from factloom.llm.words import U, blocks, flat_bytes, mix, prefix_hash, slice_hash, slices_equal

LENGTH = 100
#: Bytes of an anchor.
K = 32
#: Segments of one anchor beyond which only windows that tasks have in common are sorted.
GROUP = 2048
#: Bytes that are handled at once in a task, and segments it compares with each other before it sends them on.
CHUNK, FLUSH = 1 << 19, 400_000
#: Anchors in more than one in HOT documents of a sample (one document in HOT_SAMPLE) are hot; at most so many.
HOT, HOT_SAMPLE, HOT_MOST = 500, 16, 50_000
POSITION_BITS = 21
#: Other values of bytes, for a second hash that doesn't depend on the first.
OTHER = np.random.default_rng(61).permutation(256).astype(np.uint8)


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of data[i:i + k] for each i where it fits; it says where strings meet, not whether they are equal."""
    s = min(8, k)
    part = np.zeros(max(0, len(data) - s + 1), U)
    for i in range(s):
        part = (part << U(8)) | data[i : i + len(part)].astype(U)
    out = np.zeros(max(0, len(data) - k + 1), U)
    for i, at in enumerate([*range(0, k - s, s), k - s]):
        out += part[at : at + len(out)] * U((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)
        out ^= out >> U(29)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i:i + w]), by minima from both ends of blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def windows_of(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """First byte of each window that is in one text of a block from flat_bytes."""
    position = np.arange(max(0, len(data) - length + 1))
    return position[position + length <= np.repeat(starts[1:] - 1, np.diff(starts))[: len(position)]]


def anchor_places(data: np.ndarray, window: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all K-byte strings, and the place of each window's anchor."""
    hashes = gram_hash(data, k)
    packed = (hashes & ~U((1 << POSITION_BITS) - 1)) | np.arange(len(hashes), dtype=U)
    return hashes, (sliding_min(packed, length - k + 1)[window] & U((1 << POSITION_BITS) - 1)).astype(np.int64)


def anchors_of(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Text, anchor, two hashes, first window (in its text and in data) and number of windows of each segment."""
    window = windows_of(data, starts, length)
    if not len(window):
        none = np.zeros(0, np.int64)
        return none, none.view(U), none.view(U), none.view(U), none, none, none
    hashes, at = anchor_places(data, window, length, k)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    anchor, begin, end = hashes[at[first]], window[first], window[last]
    place = mix(anchor + (at[first] - begin).astype(U))
    seg, other = (mix(slice_hash(prefix_hash(x), begin, end + length) ^ place) | U(1) for x in (data, OTHER[data]))
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[begin]
    return doc, anchor, seg, other, begin - starts[doc], begin, end - begin + 1


def text_segments(batch: pa.RecordBatch, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """anchors_of for all rows of a batch, of which `text` is the last column, and the bytes; texts count from its first row."""
    at = 0
    for part in blocks(batch, limit=CHUNK):
        data, starts = flat_bytes(part.column(part.num_columns - 1))
        if len(data) <= 2 * CHUNK:
            doc, *rest = anchors_of(data, starts, length, k)
            yield doc + at, *rest, data
        else:  # one long text, in pieces that overlap; a segment over a border comes as two
            for lo in range(0, len(data) - length, CHUNK):
                piece = np.append(data[lo : min(lo + CHUNK + length - 1, len(data) - 1)], np.uint8(32))
                doc, anchor, seg, other, start, begin, windows = anchors_of(piece, np.array([0, len(piece)]), length, k)
                yield doc + at, anchor, seg, other, start + lo, begin, windows, piece
        at += part.num_rows


def hot_anchors(docs: DataFrame, length: int, k: int) -> np.ndarray:
    """Anchors in more than one in HOT of the documents, as a sample of them shows; sorted.

    The list only routes: whatever it names or misses, the result is the same. A document has some dozens of
    anchors, so few anchors can be so frequent, whatever the size of the corpus; HOT_MOST is the bound.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[:2] for x in text_segments(batch, length, k)]
            doc, anchor = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U))
            by = np.lexsort((anchor, doc))
            doc, anchor = doc[by], anchor[by]
            once = np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])])[: len(doc)]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[once].view(np.int64))], ["anchor"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("hot")), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(run, "anchor long").groupBy("anchor").count()
    least = max(8, docs.count() // HOT_SAMPLE // HOT)
    rows = counts.filter(F.col("count") >= least).orderBy(F.desc("count"), "anchor").limit(HOT_MOST).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(U))


def leaders(docs: DataFrame, hot: np.ndarray, length: int, k: int) -> DataFrame:
    """key, seg, doc_id, at (start << 8 | windows): each segment a task sees first, by place.

    The others that the task has seen are later copies whatever other tasks see, since their bytes are those of
    one it saw before; they come as merged runs, with seg 0 and at = start << 32 | end, and so a segment sends at
    most one row per task and flush. key is the anchor, but for hot anchors a second hash of the segment, which
    spreads them (odd; other keys are even).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, 0

        def out() -> pa.RecordBatch:
            data = np.concatenate([h[-1] for h in held])
            anchor, seg, other, doc, start, begin, windows = (np.concatenate(c) for c in list(zip(*held, strict=True))[:-1])
            held.clear()
            by = np.lexsort((start, doc))
            by = by[np.concatenate([[True], (doc[by[1:]] != doc[by[:-1]]) | (start[by[1:]] != start[by[:-1]])])[: len(by)]]  # a repeated row
            anchor, seg, other, doc, start, begin, windows = (c[by] for c in (anchor, seg, other, doc, start, begin, windows))
            _, first, inverse = np.unique(seg, return_index=True, return_inverse=True)
            like = first[inverse]
            late = np.flatnonzero(like != np.arange(len(seg)))
            same = windows[late] == windows[like[late]]
            same[same] = slices_equal(data, begin[late[same]], begin[like[late[same]]], windows[late[same]] + length - 1)
            seg[late[~same]] = mix(seg[late[~same]] + late[~same].astype(U)) | U(1)  # of one hash, but not equal
            late = late[same]
            lead = np.ones(len(seg), bool)
            lead[late] = False
            key = anchor & ~U(1)
            if len(hot):
                near = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                key = np.where(hot[near] == anchor, other | U(1), key)
            d, a, b = merge_ranges(doc[late], start[late], start[late] + windows[late] + length - 1)
            cols = [np.concatenate([key[lead], mix(d.view(U) ^ mix(a.view(U))) & ~U(1)]).view(np.int64), np.concatenate([seg[lead], np.zeros(len(d), U)]).view(np.int64), np.concatenate([doc[lead], d]), np.concatenate([(start[lead] << 8) | windows[lead], (a << 32) | b])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "seg", "doc_id", "at"])

        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            for doc, anchor, seg, other, start, begin, windows, data in text_segments(batch, length, k):
                held.append((anchor, seg, other, ids[doc], start, begin + at, windows, data))
                size, at = size + len(doc), at + len(data)
                if size > FLUSH or at > 16 * CHUNK:
                    yield out()
                    size = at = 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "key long, seg long, doc_id long, at long")


def merge_ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ranges sorted by document and start, of which no range ends before an earlier one does."""
    if not len(doc):
        return doc, start, end
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])]))
    return doc[cut], start[cut], end[np.concatenate([cut[1:], [len(doc)]]) - 1]


def settled(rows: DataFrame, length: int) -> DataFrame:
    """kind, key, doc_id, at, from leaders: kind 0 is a later copy (at: start << 32 | end), 1 and 2 are first
    segments that share their anchor with others (at: start << 8 | windows): 1 to be sorted with those of
    the same key, 2 of keys with more than GROUP segments and of hot anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        many: int | None = None

        def judge(x: np.ndarray, going_on: bool) -> pa.RecordBatch:
            nonlocal many
            key, seg, doc, at = x[:, np.concatenate([[True], (x[:, 1:] != x[:, :-1]).any(axis=0)])]  # a row may be repeated
            run_row = seg == 0
            new_seg = np.concatenate([[True], (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])])
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new_key) - 1
            firsts = np.bincount(group[new_seg & ~run_row], minlength=group[-1] + 1)
            bound = firsts[group]
            first_of_many = key == many if many is not None else np.zeros(len(key), bool)
            kind = np.where(run_row | ~new_seg, 0, np.where((bound > GROUP) | (key & 1 == 1) | first_of_many, 2, np.where(bound > 1, 1, -1)))
            keep = kind >= 0
            late = (kind == 0) & ~run_row
            ends = (at >> 8) + (at & 255) + length - 1
            at = np.where(late, ((at >> 8) << 32) | ends, at)
            many = int(key[-1]) if going_on else None
            return pa.RecordBatch.from_arrays([pa.array(kind[keep].astype(np.int8)), pa.array(key[keep]), pa.array(doc[keep]), pa.array(at[keep])], ["kind", "key", "doc_id", "at"])

        def copies(x: np.ndarray) -> pa.RecordBatch:
            start = x[3] >> 8
            at = (start << 32) | (start + (x[3] & 255) + length - 1)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(x.shape[1], np.int8)), pa.array(x[0]), pa.array(x[2]), pa.array(at)], ["kind", "key", "doc_id", "at"])

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(np.stack([c.to_numpy() for c in batch.columns]))
            x = np.concatenate(waiting, axis=1)
            cut = int(np.searchsorted(x[0], x[0][-1]))  # the last key may go on
            if cut:
                yield judge(x[:, :cut], False)
                x = x[:, cut:]
            if x.shape[1] > 4 * GROUP + 4:
                # a key of very many rows: what is held is judged as of many, up to the last segment, which may go on
                cut = int(np.searchsorted(x[1], x[1][-1])) if x[1][0] != x[1][-1] else 0
                if not cut and x[1][0]:  # of one segment: all but its first row are later copies
                    yield copies(x[:, 1:])
                    x = x[:, :1]
                if cut > GROUP:
                    many = int(x[0][0])
                    yield judge(x[:, :cut], True)
                    x = x[:, cut:]
            waiting = [x]
        if waiting and waiting[0].shape[1]:
            yield judge(np.concatenate(waiting, axis=1), False)

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "seg", "doc_id", "at")
    return dealt.select("key", "seg", "doc_id", "at").mapInArrow(run, "kind byte, key long, doc_id long, at long")


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For the suffixes of data at `starts`, dense ranks by their first `length` bytes, by prefix doubling.

    data has `length` further bytes after each start. Ranks are of all positions from which `done` bytes fit.
    """
    n = len(data) - 7
    key = np.zeros(n, U)
    for i in range(8):
        key = (key << U(8)) | data[i : i + n].astype(U)
    ranks = np.unique(key, return_inverse=True)[1].astype(np.int64)
    done = 8
    while done < length:
        step = min(done, length - done)
        m = len(ranks) - step
        at = starts if done + step == length else np.arange(m)
        pair = (ranks[at].astype(U) << U(32)) | ranks[at + step].astype(U)
        ranks = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        done += step
    return ranks


def previous_factors(place: list[int], common: list[int]) -> list[int]:
    """Longest previous factors of suffixes in suffix order, from the place of each in the corpus and the length of
    its common prefix with the suffix before it (0 for the first).

    A stack holds suffixes of rising places. The suffix that takes one off it is its next smaller position, the one
    below it its previous smaller one; their common prefixes with it are the least ones between.
    """
    out, stack = [0] * len(place), []
    for i in range(len(place) + 1):
        here, prefix = (place[i], common[i]) if i < len(place) else (-1, 0)
        while stack and place[stack[-1][0]] > here:
            top, before = stack.pop()
            out[top] = max(before, prefix)
            prefix = min(before, prefix)
        if i < len(place):
            stack.append((i, prefix))
    return out


def later_copies(data: np.ndarray, starts: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor of each suffix of data at `starts` is `length` or more.

    Common prefixes are of all suffixes the longest with the neighbours in suffix order; suffixes that share less
    than `length` with both can't reach it and stay off the stack. Shorter common prefixes count as 0 there.
    """
    ranks = suffix_ranks(data, starts, length)
    by = np.lexsort((place, ranks))
    same = np.zeros(len(by) + 1, bool)
    same[1:-1] = ranks[by[1:]] == ranks[by[:-1]]
    on = np.flatnonzero(same[:-1] | same[1:])
    factors = previous_factors(place[by[on]].tolist(), np.where(same[on], length, 0).tolist())
    out = np.zeros(len(by), bool)
    out[by[on]] = np.array(factors, np.int64) >= length
    return out


def runs_of(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of maximal runs of window starts (sorted by document and start)."""
    if not len(doc):
        return doc, start, start
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)]))
    end = start[np.concatenate([cut[1:], [len(doc)]]) - 1] + length
    return doc[cut], start[cut], end


def sorted_suffix_runs(firsts: DataFrame, length: int) -> DataFrame:
    """doc_id, start, end of later copies among anchor, doc_id, start, windows, bytes (all segments of an anchor)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch | None:
            keys = np.stack([t.column(c).to_numpy() for c in ("anchor", "doc_id", "start")])
            t = t.filter(pa.array(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])))  # a repeated row
            doc, start, windows = (t.column(c).to_numpy() for c in ("doc_id", "start", "windows"))
            data, at = flat_bytes(t.column("bytes"))
            data = np.concatenate([data, np.zeros(length, np.uint8)])
            total = int(windows.sum())
            inner = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
            suffix = np.repeat(at[:-1], windows) + inner
            w_doc, w_start = np.repeat(doc, windows), np.repeat(start, windows) + inner
            place = np.empty(total, np.int64)
            by = np.lexsort((w_start, w_doc))
            place[by] = np.arange(total)
            hit = np.flatnonzero(later_copies(data, suffix, place, length))
            hit = hit[np.argsort(place[hit], kind="stable")]
            if len(hit):
                d, a, b = runs_of(w_doc[hit], w_start[hit], length)
                return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(b)], ["doc_id", "start", "end"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            if sum(b.num_rows for b in rest) < 10_000:
                continue
            t = pa.Table.from_batches(rest)
            anchor = t.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            rest = t.slice(cut).to_batches()
            if cut and (found := solve(t.slice(0, cut))) is not None:
                yield found
        if rest and (found := solve(pa.Table.from_batches(rest))) is not None:
            yield found

    dealt = firsts.repartition(partitions(firsts.sparkSession), "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return dealt.select("anchor", "doc_id", "start", "windows", "bytes").mapInArrow(run, "doc_id long, start long, end long")


def cut_segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """kind, anchor, doc_id, start, windows, bytes for each row of wanted (all but bytes); of repeated rows, mostly one."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "kind")).alias("segs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = []

        def out() -> pa.RecordBatch:
            cols = [pa.concat_arrays(c) for c in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, ["kind", "anchor", "doc_id", "start", "windows", "bytes"])

        last = None
        for batch in batches:
            for r, doc in enumerate(batch.column(0).to_pylist()):
                if doc == last:  # a repeated row; the join has sorted them
                    continue
                last = doc
                text = batch.column(1)[r].as_buffer().to_pybytes()
                segs = batch.column(2)[r].values
                anchor, start, windows, kind = (segs.field(i) for i in range(4))
                cut = [text[a : a + w + length - 1] for a, w in zip(start.to_pylist(), windows.to_pylist(), strict=True)]
                held.append([kind, anchor, pa.repeat(batch.column(0)[r], len(cut)), start, windows, pa.array(cut, pa.binary())])
                if len(held) >= 256:
                    yield out()
        if held:
            yield out()

    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(lists.hint("merge"), "doc_id")
    return joined.select("doc_id", "text", "segs").mapInArrow(run, "kind byte, anchor long, doc_id long, start long, windows int, bytes binary")


def window_rows(segs: DataFrame, length: int) -> DataFrame:
    """h1, h2 (128 bits of each window's bytes), doc_id, segment, start, run: the window a task sees first, by place.

    segment is the start of the segment that a window is of. The others that a task has seen are later copies
    whatever other tasks see, since their bytes are those of one it saw before; they come as merged runs (start <<
    32 | end, null for windows), and so a window sends at most one row per task and flush.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shift = [], 0, 0

        def out() -> pa.RecordBatch:
            data = np.concatenate([h[-1] for h in held])
            h1, h2, doc, segment, start, begin = (np.concatenate(c) for c in list(zip(*held, strict=True))[:-1])
            held.clear()
            by = np.lexsort((start, doc, h2, h1))
            h1, h2, doc, segment, start, begin = (c[by] for c in (h1, h2, doc, segment, start, begin))
            other = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(h1)]
            like = np.maximum.accumulate(np.where(other, np.arange(len(h1)), 0))
            rest = np.flatnonzero(~other)
            other[rest[~slices_equal(data, begin[rest], begin[like[rest]], np.full(len(rest), length))]] = True
            late = np.flatnonzero(~other & ((doc != doc[like]) | (start != start[like])))
            late = late[np.lexsort((start[late], doc[late]))]
            d, a, b = runs_of(doc[late], start[late], length)
            none = np.zeros(int(other.sum()), np.int64)
            cols = [np.concatenate([x[other].view(np.int64), y]) for x, y in ((h1, 0 * d), (h2, 0 * d), (doc, d), (segment, 0 * d), (start, a))]
            runs = pa.array(np.concatenate([none, (a << 32) | b]), mask=np.arange(len(none) + len(d)) < len(none))
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), runs], ["h1", "h2", "doc_id", "segment", "start", "run"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                t = batch.slice(lo, 4096)
                data, at = flat_bytes(t.column(3))
                windows = t.column(2).to_numpy()
                inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                begin = np.repeat(at[:-1], windows) + inner
                h1, h2 = (slice_hash(prefix_hash(x), begin, begin + length) for x in (data, OTHER[data]))
                segment = np.repeat(t.column(1).to_numpy(), windows)
                held.append((h1, h2, np.repeat(t.column(0).to_numpy(), windows), segment, segment + inner, begin + shift, data))
                size, shift = size + len(h1), shift + len(data)
                if size > FLUSH:
                    yield out()
                    size = shift = 0
        if held:
            yield out()

    return segs.select("doc_id", "start", "windows", "bytes").mapInArrow(run, "h1 long, h2 long, doc_id long, segment long, start long, run long")


def common_windows(segs: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """anchor, doc_id, start, windows (1), bytes of windows (h1, doc_id, segment, start) of segs; anchor is h1, so that
    equal windows alone meet."""
    lists = windows.groupBy("doc_id", "segment").agg(F.collect_list(F.struct("start", "h1")).alias("starts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists, many = part.column(2), part.column(2).value_lengths()
                of = pa.array(np.repeat(np.arange(part.num_rows), many.to_numpy()))
                start, h1 = (lists.flatten().field(i) for i in range(2))
                at = (start.to_numpy() - part.column(1).take(of).to_numpy()).tolist()
                raws = part.column(3).to_pylist()
                cut = pa.array([raws[i][a : a + length] for i, a in zip(of.to_pylist(), at, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([h1, part.column(0).take(of), start, pa.array(np.ones(len(of), np.int32)), cut], ["anchor", "doc_id", "start", "windows", "bytes"])

    joined = segs.select("doc_id", F.col("start").alias("segment"), "bytes").join(lists.hint("merge"), ["doc_id", "segment"])
    return joined.select("doc_id", "segment", "starts", "bytes").mapInArrow(run, "anchor long, doc_id long, start long, windows int, bytes binary")


def repeated_runs(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, runs (start << 32 | end, in any order, may overlap) of the documents that lose a part."""
    rows = written(settled(leaders(docs, hot_anchors(docs, length, k), length, k), length), "settled")
    whole = rows.filter("kind = 0").select("doc_id", F.col("at").alias("run"))
    open_ = rows.filter("kind > 0").select("kind", F.col("key").alias("anchor"), "doc_id", F.shiftrightunsigned("at", 8).alias("start"), F.col("at").bitwiseAND(255).cast("int").alias("windows"))
    cut = cut_segments(docs, open_, length)
    packed = F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("end")).alias("run")
    names = ["anchor", "doc_id", "start", "windows", "bytes"]
    if rows.filter("kind = 2").isEmpty():
        alike = cut.select(names)
    else:
        cut = written(cut, "segments")
        many = cut.filter("kind = 2").select(names)
        windows = written(window_rows(many, length), "windows")
        whole = whole.union(windows.filter("run is not null").select("doc_id", "run"))
        firsts = windows.filter("run is null")
        shared = firsts.groupBy("h1", "h2").count().filter("count > 1").drop("count")
        shared = firsts.join(shared.hint("merge"), ["h1", "h2"]).select("h1", "doc_id", "segment", "start")
        alike = cut.filter("kind = 1").select(names).union(common_windows(many, shared, length))
    found = whole.union(sorted_suffix_runs(alike, length).select("doc_id", packed))
    return written(found.groupBy("doc_id").agg(F.collect_list("run").alias("runs")), "runs")


def merged(runs: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs."""
    runs = np.sort(runs)
    start, end = runs >> 32, np.maximum.accumulate(runs & 0xFFFFFFFF)
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return np.stack([start[cut], end[np.concatenate([cut[1:], [len(runs)]]) - 1]], axis=1)


def whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of a span of UTF-8 bytes that is whole characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, as_text: bool = False) -> DataFrame:
    """docs' rows with n_bytes, removed_spans (start, end of each maximal run in bytes) and kept_bytes.

    With as_text there is kept_text instead of kept_bytes: a character of which a span has only some bytes stays.

    docs: doc_id (long), text; texts are UTF-8 bytes, null is empty; matches never cross documents. Rows of
    equal doc_id and text are one document and get the same answer. Of rows that share a doc_id but not
    the text, the one of the least SHA-256 is the document; the others, and rows of a null doc_id, pass
    whole and are nobody's earlier copy. Texts under `length` bytes pass whole. Other columns are kept,
    but for ones named n_bytes, removed_spans, kept_bytes or kept_text.
    """
    if length < 16:
        raise ValueError("strings of 16 bytes at least")
    k = min(k, length // 3)
    if length - k > 254:
        raise ValueError("the anchor is too short for this length")
    docs = docs.drop("n_bytes", "removed_spans", "kept_bytes", "kept_text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    order = docs.columns
    others = [c for c in order if c not in ("doc_id", "text")]
    # other columns go as one, so that helper names don't meet the table's
    docs = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("_")).alias("rest"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    digests = docs.filter("doc_id is not null").select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    with scratch() as keep:
        clash = written(digests.filter("least <> most").select("doc_id", "least"), "clashes")
        ours = docs.withColumn("ours", F.col("doc_id").isNotNull())
        if clash.isEmpty():
            deleted(clash)
        else:
            ours = docs.join(clash, "doc_id", "left").withColumn("ours", F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("least") == digest))).drop("least")
        runs = repeated_runs(ours.filter("ours").select("doc_id", "text"), length, k)
        keep(clash, runs)
    names = ["doc_id", "rest"]
    joined = ours.join(runs.hint("merge"), "doc_id", "left").select(*names, "text", F.when(F.col("ours"), F.col("runs")).alias("_runs"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            texts = batch.column(len(names)).cast(pa.binary())
            runs = batch.column(len(names) + 1)
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                n_bytes.append(len(raw))
                if runs[i].is_valid:
                    m = merged(runs[i].values.to_numpy())
                    spans.append([{"start": int(a), "end": int(b)} for a, b in m])
                    gone = m.tolist()
                    if as_text:
                        gone = [whole_characters(raw, a, b) for a, b in gone]
                    ends = [0, *(b for _, b in gone)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(raw)], strict=True)))
                else:
                    spans.append([])
                    kept.append(raw)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(len(names) + 1)], pa.array(n_bytes, pa.int64()), pa.array(spans, span), pa.array([x.decode() for x in kept] if as_text else kept, pa.string() if as_text else pa.binary())], [*names, "text", "n_bytes", "removed_spans", last[0]])

    last = ("kept_text", "string") if as_text else ("kept_bytes", "binary")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*names, "text").schema)
    done = joined.mapInArrow(cut, f"{fields}, n_bytes long, removed_spans array<struct<start:long,end:long>>, {last[0]} {last[1]}")
    return done.select(*(F.col(f"rest.`{c}`").alias(c) if c in others else c for c in order), "n_bytes", "removed_spans", last[0])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
