"""License scans by conditional compression.

1. Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower case, so that comment
   marks, line breaks and punctuation say nothing. Three words in a row that some template has are an
   anchor; anchors with small gaps make a region, and no match with few enough differences leaves one.
2. A region is scanned in overlapping blocks of bounded length. A block is a candidate if it has as many of
   a template's anchors as a match must have. It is compressed alone and with each template as a raw
   zstandard dictionary, and templates are ranked by how much smaller the block becomes.
3. In that order, a template is aligned with the block word by word. The first whose wording differs in at
   most a tenth of its words, none of them a version number, is found there; what is left of the block is scanned
   on. Numbers of list items are words like others. Where a version number refutes a place, the template's
   other places in the block are looked at, those of fewer differences first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.license_texts import BEGINNINGS, SHORT
from factloom.llm.words import U, blocks, flat_bytes, prefix_hash, shingle_hash, slice_hash, word_bounds

SIZE = 3
#: A template of n words may differ in n // TOLERANCE of them.
TOLERANCE = 10
LEVEL = 6
#: Words of a part of a long template.
PART_WORDS = 250
#: The number of a list item stands where a sentence may begin: "1." or "(1)".
ITEM = re.compile(r"(?:^|(?<=[.:;,)])\s|\n)\s*\(?(\d+)[.)]\s")
#: What a version number follows, or has before it in one word.
VERSION, VERSIONED = {b"version", b"versions", b"v", b"ver"}, re.compile(rb"(?:v|ver|version|[al]?gplv?|mplv?|apache|bsd|cc)\d+")
DIGIT = re.compile(rb"\d")

# The public wording of licenses and of the notices that stand for them.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_TWO_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version."""
TEMPLATES = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. """
        + _WARRANTY,
    ),
    ("BSD-2-Clause", _TWO_CLAUSES + " " + _BSD_WARRANTY),
    (
        "BSD-3-Clause",
        _TWO_CLAUSES
        + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. """
        + _BSD_WARRANTY,
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied.""",
    ),
    ("GPL-2.0-or-later", _GNU.format(what="program", name="General Public License", version=2)),
    ("GPL-3.0-or-later", _GNU.format(what="program", name="General Public License", version=3)),
    ("LGPL-2.1-or-later", _GNU.format(what="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0-or-later", _GNU.format(what="library", name="Lesser General Public License", version=3)),
    ("AGPL-3.0-or-later", _GNU.format(what="program", name="Affero General Public License", version=3)),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *SHORT,
    *BEGINNINGS,
]

#: Bytes of words as they are compared; others part words.
FOLD = np.full(256, 32, np.uint8)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    FOLD[list(_range)] = list(_range)
FOLD[65:91] = np.arange(97, 123)


def in_parts(name: str, text: str, words: int = PART_WORDS) -> list[tuple[str, str]]:
    """A text as templates of one name, of up to `words` words each: an alignment's cost is that of a part's length."""
    own = text.split()
    return [(name, " ".join(own[i : i + words])) for i in range(0, len(own), words)]


def folder_templates(path: str, words: int = PART_WORDS) -> list[tuple[str, str]]:
    """Templates of all text files of a folder that the driver sees, named by their files, long ones in parts.

    A whole copy of a license is found as its parts, one after another.
    """
    files = sorted(f for f in os.listdir(path) if os.path.isfile(os.path.join(path, f)))
    out = []
    for f in files:
        with open(os.path.join(path, f), encoding="utf-8", errors="replace") as file:
            out += in_parts(os.path.splitext(f)[0], file.read(), words)
    return out


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
        self.most = len(self.words) // TOLERANCE
        items = {len(FOLD[np.frombuffer(text[: m.start(1)].encode(), np.uint8)].tobytes().split()) for m in ITEM.finditer(text)}
        self.versions = {i for i, w in enumerate(self.words) if DIGIT.search(w) and (i not in items or i > 0 and self.words[i - 1] in VERSION)}
        raw = b" ".join(self.words)
        self.dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.dictionary.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(dict_data=self.dictionary, level=LEVEL)
        data, starts = flat_bytes(pa.array([raw], pa.binary()))
        begin, end, _ = word_bounds(data, starts)
        self.anchors = np.unique(shingle_hash(slice_hash(prefix_hash(data), begin, end), SIZE))
        #: Each difference takes away three anchors at most.
        self.least = max(1, len(self.anchors) - SIZE * self.most)

    def align(self, words: list[bytes]) -> tuple[int, int, int, list[str]] | None:
        """Cost, start and end of the words that differ least from the template, the earliest such end, and the differences.

        Only places that no version number refutes, and that have few enough differences.
        """
        n, m = len(words), len(self.words)
        code = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        text = np.array([code.get(w, -1) for w in words], np.int32)
        column = np.arange(n + 1, dtype=np.int32)
        cost = np.zeros((m + 1, n + 1), np.int32)
        for i, w in enumerate(self.words, 1):
            row = np.append(np.int32(i), np.minimum(cost[i - 1, :-1] + (text != code[w]), cost[i - 1, 1:] + 1))
            cost[i] = np.minimum.accumulate(row - column) + column
        ends = np.flatnonzero(cost[m] <= self.most)
        for end in ends[np.argsort(cost[m, ends], kind="stable")].tolist():
            i, j, found, refuted = m, end, [], False
            while i and not refuted:
                if j and cost[i, j] == cost[i - 1, j - 1] + (text[j - 1] != code[self.words[i - 1]]):
                    i, j = i - 1, j - 1
                    if text[j] != code[self.words[i]]:
                        found += [b"+" + words[j], b"-" + self.words[i]]
                        refuted = i in self.versions or self.is_version(words, j, i - 1, i + 1)
                elif cost[i, j] == cost[i - 1, j] + 1:
                    i -= 1
                    found.append(b"-" + self.words[i])
                    refuted = i in self.versions
                else:
                    j -= 1
                    found.append(b"+" + words[j])
                    refuted = self.is_version(words, j, i - 1, i)
            if not refuted:
                return int(cost[m, end]), j, end, [x.decode(errors="replace") for x in found[::-1]]
        return None

    def is_version(self, words: list[bytes], j: int, before: int, after: int) -> bool:
        """Whether word j of a text, between two words of the template, is or belongs to a version number."""
        w = words[j]
        if not DIGIT.search(w):
            return False
        return before in self.versions or after in self.versions or VERSIONED.fullmatch(w) is not None or j > 0 and words[j - 1] in VERSION


class Scanner:
    """The templates, ready to be searched for; made once in each task."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.templates = [t for t in (Template(*x) for x in templates) if len(t.words) >= SIZE]
        every = [(a, k) for k, t in enumerate(self.templates) for a in t.anchors.tolist()]
        self.anchors = np.unique(np.array([a for a, _ in every], U))
        self.of = np.zeros((len(self.templates), len(self.anchors)), np.int32)
        for a, k in every:
            self.of[k, np.searchsorted(self.anchors, U(a))] = 1
        self.least = np.array([t.least for t in self.templates])
        self.pad = SIZE * (max((t.most for t in self.templates), default=0) + 1)
        self.step = max((len(t.words) for t in self.templates), default=0) + self.pad
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.seen: dict[bytes, tuple | None] = {}

    def regions(self, hits: np.ndarray, first: int, end: int) -> list[tuple[int, int]]:
        """Bounds of runs of anchors (word numbers, ascending) of a text of words first..end, with what may belong to them."""
        if not len(hits):
            return []
        cut = np.flatnonzero(np.diff(hits) > 2 * self.pad)
        return [(max(first, int(a) - self.pad), min(end, int(b) + SIZE + self.pad)) for a, b in zip(hits[np.append(0, cut + 1)], hits[np.append(cut, len(hits) - 1)], strict=True)]

    def best(self, words: list[bytes]) -> tuple | None:
        """(template, start, end, reduction, differences) of the template found in a candidate block."""
        block = b" ".join(words)
        if block in self.seen:
            return self.seen[block]
        size = len(self.plain.compress(block))
        rank = [(size - len(t.compressor.compress(block)), t) for t in self.templates]
        found = []
        for saved, t in sorted(rank, key=lambda x: -x[0]):
            if saved <= 0 or found and saved < found[0][0]:
                break
            if place := t.align(words):
                cost, start, end, differences = place
                found.append((saved, cost, t.name, start, end, differences))
        out = None
        if found:
            saved, _, name, start, end, differences = min(found, key=lambda x: (-x[0], x[1], x[2]))
            out = (name, start, end, saved / size, differences)
        if len(self.seen) < 4096 and len(block) < 4096:
            self.seen[block] = out
        return out

    def scan(self, words: list[bytes], slots: np.ndarray) -> tuple[int, list[tuple]]:
        """Candidate blocks, and what is found in a region; slots: each word's anchor, or -1."""
        out, blocks_, rest = [], 0, [(0, len(words))]
        while rest:
            lo, hi = rest.pop()
            if hi - lo < SIZE:
                continue
            to = min(hi, lo + 2 * self.step)
            here = slots[lo : to - SIZE + 1]
            have = self.of[:, np.unique(here[here >= 0])].sum(axis=1)
            got = None
            if (have >= self.least).any():
                blocks_ += 1
                got = self.best(words[lo:to])
            if got:
                name, a, b, saved, differences = got
                out.append((name, lo + a, lo + b, saved, differences))
                rest += [(lo + b, hi), (lo, lo + a)]
            elif to < hi:
                rest.append((lo + self.step, hi))
        return blocks_, sorted(out, key=lambda x: x[1])


FOUND = "array<struct<license: string, start: bigint, end: bigint, reduction: double, differences: array<string>>>"
FOUND_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("differences", pa.list_(pa.string()))]))


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_blocks (candidates compressed), found for each row of docs (doc_id, text); nothing is shuffled.

    found lists, in order of place: license, start and end (bytes of the UTF-8 text), reduction (share of the
    block's compressed size that the template saves) and differences (`+word` is in the text alone, `-word` in
    the template alone). templates: (name, text) pairs, TEMPLATES if none are given; those of fewer than three
    words take no part. Null, empty and short texts have nothing; repeated rows are judged alike, a null doc_id
    stays null; other columns are not read. Of templates that save as much, that of fewer differences, then of
    the lesser name, is taken.
    """
    chosen = TEMPLATES if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            for part in blocks(batch):
                data, starts = flat_bytes(part.column(1))
                data = FOLD[data]
                begin, end, first = word_bounds(data, starts)
                three = shingle_hash(slice_hash(prefix_hash(data), begin, end), SIZE)
                slots = np.full(len(begin), -1)
                if len(three) and len(scanner.anchors):
                    at = np.minimum(np.searchsorted(scanner.anchors, three), len(scanner.anchors) - 1)
                    slots[: len(three)] = np.where(scanner.anchors[at] == three, at, -1)
                hits, counts, found = np.flatnonzero(slots >= 0), np.zeros(part.num_rows, np.int64), [[] for _ in range(part.num_rows)]
                within = np.searchsorted(hits, first)
                for d in np.flatnonzero(np.diff(within)):
                    for lo, hi in scanner.regions(hits[within[d] : within[d + 1]], int(first[d]), int(first[d + 1])):
                        words = data[begin[lo] : end[hi - 1]].tobytes().split()
                        n, got = scanner.scan(words, slots[lo:hi])
                        counts[d] += n
                        for name, a, b, saved, differences in got:
                            found[d].append({"license": name, "start": int(begin[lo + a] - starts[d]), "end": int(end[lo + b - 1] - starts[d]), "reduction": saved, "differences": differences})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(found, FOUND_ARROW)], ["doc_id", "n_blocks", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_blocks long, found {FOUND}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: candidate blocks, licenses in order of place, their spans, reductions and differing words."""
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_blocks",
        F.size("found").cast("long").alias("n_found"),
        F.col("found.license").alias("licenses"),
        F.col("found.start").alias("starts"),
        F.col("found.end").alias("ends"),
        F.col("found.reduction").alias("reductions"),
        F.flatten("found.differences").alias("differences"),
    )


QUERIES = {"op2_license_scan": op2_license_scan}
