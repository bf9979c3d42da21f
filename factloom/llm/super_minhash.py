"""SuperMinHash signatures of word-shingle sets.

Each element permutes the registers; in round j it offers j plus a fraction to the register that its
permutation names j-th, and a register keeps its least offer. The rounds run over all elements of a
document at once: after round j no later offer is below j + 1, so a document whose registers all hold
less stops. That is the same signature as going element by element, and for documents of many shingles
it ends after a round or two.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from factloom.llm.words import SPACE, U, flat_bytes, lower_ascii, mix, prefix_hash, shingle_hash, slice_hash, word_bounds, word_ids


class Words:
    """The words of a block of texts, A-Z lower-cased."""

    def __init__(self, texts: pa.Array):
        data, self.starts = flat_bytes(texts)
        self.data = lower_ascii(data)
        self.begin, self.end, self.first = word_bounds(self.data, self.starts)
        self.hashes = slice_hash(prefix_hash(self.data), self.begin, self.end)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)

    def windows(self, size: int) -> np.ndarray:
        """First word of each run of `size` words that is in one text."""
        at = np.arange(max(0, len(self.doc) - size + 1))
        return at[self.doc[at] == self.doc[at + size - 1]]

    def digests(self) -> list[bytes]:
        """128 bits of a cryptographic hash of each text's words in turn."""
        gap = SPACE[self.data]
        keep = ~gap
        keep[1:] |= ~gap[:-1]
        plain = np.where(gap, np.uint8(32), self.data)[keep].tobytes()
        at = np.concatenate([[0], np.cumsum(keep)])[self.starts].tolist()
        return [hashlib.blake2b(plain[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def grouped(of: np.ndarray, n: int) -> np.ndarray:
    """The n + 1 firsts of sorted numbers below n."""
    return np.searchsorted(of, np.arange(n + 1))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, one text after another, and the n + 1 firsts.

    A text of fewer than `size` words, but one at least, is one shingle.
    """
    at = words.windows(size)
    hashes, of = shingle_hash(words.hashes, size)[at], words.doc[at]
    for few in range(1, size):
        short = np.flatnonzero(words.n == few)
        if len(short):
            hashes = np.concatenate([hashes, shingle_hash(words.hashes, few)[words.first[short]]])
            of = np.concatenate([of, short])
    if not len(of):
        return hashes, np.zeros(len(words.n) + 1, np.int64)
    once = np.unique(mix(hashes + of.astype(U) * U(0xC2B2AE3D27D4EB4F)), return_index=True)[1]
    hashes, of = hashes[once], of[once]
    by = np.argsort(of, kind="stable")
    return hashes[by], grouped(of[by], len(words.n))


def exact_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingle_sets, with sorted numbers for hashes: two shingles of the block have one number if and only if
    they have the same words."""
    ids = word_ids(words.data, words.begin, words.end, words.hashes)
    at = words.windows(size)
    short = np.flatnonzero((words.n > 0) & (words.n < size))
    of = np.concatenate([words.doc[at], short])
    code, above = np.zeros(len(of), np.int64), int(ids.max(initial=0)) + 1
    bound = 1
    for k in range(size):  # words beyond the end of a short text count as 0
        there = words.n[short] > k
        after = np.zeros(len(short), np.int64)
        after[there] = ids[words.first[short[there]] + k]
        if bound * above >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            bound = int(code.max(initial=0)) + 1
        code, bound = code * above + np.concatenate([ids[at + k], after]), bound * above
    code = np.unique(code, return_inverse=True)[1]
    bound = int(code.max(initial=0)) + 1
    keys = np.unique(of * bound + code)
    return keys % bound, grouped(keys // bound, len(words.n))


def signatures(elements: np.ndarray, firsts: np.ndarray, registers: int) -> np.ndarray:
    """One row of `registers` 64-bit values (round << 32 | fraction) for each set."""
    n = len(firsts) - 1
    sig = np.full(n * registers, np.iinfo(U).max, U)
    doc, state, perm = np.repeat(np.arange(n), np.diff(firsts)), mix(elements * U(0x9E3779B97F4A7C15) + U(1)), None
    for j in range(registers):
        state = mix(state + U(0xBF58476D1CE4E5B9))
        k = (j + (((state & U(0xFFFFFFFF)) * U(registers - j)) >> U(32)).astype(np.int64)).astype(np.int64)
        if j == 0:
            register, first_k = k, k
        else:
            rows = np.arange(len(k))
            if perm is None:
                perm = np.tile(np.arange(registers, dtype=np.uint8), (len(k), 1))
                perm[rows, first_k] = 0
                perm[:, 0] = first_k
            register = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = register
        np.minimum.at(sig, doc * registers + register, (U(j) << U(32)) | (state >> U(32)))
        going = sig.reshape(n, registers).max(axis=1, initial=0) >= U(j + 1) << U(32)
        keep = going[doc]
        if not keep.any():
            break
        if not keep.all():
            doc, state, first_k = doc[keep], state[keep], first_k[keep]
            perm = perm[keep] if perm is not None else None
    return sig.reshape(n, registers)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each run of `rows` registers; the run's number goes into it."""
    n, registers = sig.shape
    out = np.zeros((n, registers // rows), U)
    out += np.arange(1, out.shape[1] + 1, dtype=U)
    cut = sig[:, : out.shape[1] * rows].reshape(n, -1, rows)
    for i in range(rows):
        out = mix(out + cut[:, :, i])
    return out
