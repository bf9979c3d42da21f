"""Words, lines and rolling hashes of whole Arrow batches of texts, in numpy.

A word is a run of bytes other than space and \\x09-\\x0D; no byte of a longer UTF-8 sequence is one of
those. Hashes are polynomials over the bytes modulo the prime 2**61 - 1, finished by a mixer; a prefix sum
of a batch gives the hash of any slice of it, so that words, lines and shingles cost a few array passes.
Where a result rests on equality, word_ids confirms equal hashes byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PRIME = (1 << 61) - 1
BASE = 0x0E3779B97F4A7C15
INVERSE = pow(BASE, -1, PRIME)
#: Bytes whose powers are kept by a worker, and steps of the inverse powers.
SPAN, SMALL = 1 << 21, 1 << 16
_powers: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any 64-bit x."""
    x = (x & U(PRIME)) + (x >> U(61))
    return x - U(PRIME) * (x >= U(PRIME))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, by halves of 30 and 31 bits."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    cross = a1 * b0 + a0 * b1
    return fold(((a1 * b1) << U(1)) + (cross >> U(30)) + ((cross & (low >> U(1))) << U(31)) + a0 * b0)


def power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo PRIME for i below n."""
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(len(out), U(pow(base, len(out), PRIME))))])
    return out[:n]


def inverse_powers(at: np.ndarray) -> np.ndarray:
    """BASE ** -i modulo PRIME for each i of at."""
    if "small" not in _powers:
        _powers["small"], _powers["large"] = power_table(INVERSE, SMALL), power_table(pow(INVERSE, SMALL, PRIME), 64)
    most = int(at.max(initial=0)) // SMALL + 1
    if most > len(_powers["large"]):
        _powers["large"] = power_table(pow(INVERSE, SMALL, PRIME), most)
    return times(_powers["small"][at % SMALL], _powers["large"][at // SMALL])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Two rows of sums of (data[j] + 1) times the upper and lower part of BASE ** j, for j < i: below 2 * PRIME,
    and right modulo PRIME."""
    most = min(SPAN, 1 << max(0, len(data) - 1).bit_length())
    if len(_powers.get("up", ())) < most:
        _powers["up"] = power_table(BASE, most)
        _powers["parts"] = halves(_powers["up"])
    sums = np.zeros((2, len(data) + 1), U)
    for at in range(0, len(data), SPAN):
        part = data[at : at + SPAN].astype(U)
        part += U(1)
        pieces = [x[: len(part)] for x in _powers["parts"]] if not at else halves(times(_powers["up"][: len(part)], np.full(len(part), U(pow(BASE, at, PRIME)))))
        for row, piece in zip(sums, pieces, strict=True):
            here = row[at + 1 : at + len(part) + 1]
            np.multiply(part, piece, out=here)
            np.cumsum(here, out=here)
            if at:
                here += fold(row[at : at + 1])
    return sums


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x >> U(31), x & U((1 << 31) - 1)


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal slices have equal hashes wherever they stand."""
    upper, lower = (row[end] + U(2 * PRIME) - row[start] for row in sums)
    value = fold((upper >> U(30)) + ((upper & U((1 << 30) - 1)) << U(31)) + lower)
    return mix(times(value, inverse_powers(start)) + (end - start).astype(U) * U(0xA24BAED4963EE407))


def slices_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, limit: int = 1 << 18) -> np.ndarray:
    """Whether data[a:a + size] is data[b:b + size], for each a, b and size; about `limit` bytes at a time."""
    out, upto, at = np.ones(len(a), bool), np.cumsum(size), 0
    while at < len(a):
        done = upto[at] - size[at]
        to = max(at + 1, int(np.searchsorted(upto, done + limit, "right")))
        if to == at + 1:
            out[at] = np.array_equal(data[a[at] : a[at] + size[at]], data[b[at] : b[at] + size[at]])
        else:
            n = size[at:to]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            same = data[np.repeat(a[at:to], n) + inner] == data[np.repeat(b[at:to], n) + inner]
            wrong = np.repeat(np.arange(at, to), n)[~same]
            out[wrong] = False
        at = to
    return out


def word_ids(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the words data[begin:end]: the same for two words if and only if their bytes are."""
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    like = first[ids]
    size = end - begin
    same = size == size[like]
    if same.all() and slices_equal(data, begin, begin[like], size).all():
        return ids + 1
    known: dict[bytes, int] = {}  # two words of one hash: words are told apart by their bytes
    return np.array([known.setdefault(data[a:b].tobytes(), len(known) + 1) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array, with a space after each text, and the n + 1 starts of texts.

    Null texts are empty. Text i is data[starts[i]:starts[i + 1] - 1].
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    lengths = np.diff(offsets)
    if texts.null_count:
        lengths = np.where(np.asarray(texts.is_null()), 0, lengths)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    data = np.full(starts[-1], 32, np.uint8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    if n and offsets[-1] - offsets[0] == lengths.sum():
        keep = np.ones(starts[-1], bool)
        keep[starts[1:] - 1] = False
        data[keep] = raw[offsets[0] : offsets[-1]]
    else:
        for i in range(n):
            data[starts[i] : starts[i] + lengths[i]] = raw[offsets[i] : offsets[i] + lengths[i]]
    return data, starts


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in data, and the n + 1 first words of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[0::2], edge[1::2]  # the last byte is a space
    return begin, end, np.searchsorted(begin, starts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def shingle_hash(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of words[i:i + size] for each i where it fits, from the hashes of the words."""
    if len(words) < size:
        return np.zeros(0, U)
    out = np.zeros(len(words) - size + 1, U)
    for k in range(size):
        out = mix(out + words[k : k + len(out)] + U(k + 1))
    return out


def doc_of(first: np.ndarray, n: int) -> np.ndarray:
    """For n items of which text i has first[i]:first[i + 1], the text of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def blocks(batch: pa.RecordBatch, text: str = "text", limit: int = 2 << 20, most: int = 4095):
    """The batch in slices of about `limit` bytes of text and `most` rows (a longer text is a slice by itself)."""
    texts = batch.column(batch.schema.get_field_index(text))
    sizes = np.nan_to_num(np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), float)).astype(np.int64) + 1 if batch.num_rows else np.zeros(0, np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = min(at + most, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))))
        yield batch.slice(at, to - at)
        at = to
