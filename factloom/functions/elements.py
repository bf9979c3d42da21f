"""Elements of a page as intervals: one sweep over its tags with a stack, in tasks; what is inside what is then a matter
of numbers, in SQL functions.

Elements stand in the order of their start tags, so all that is inside element i are the next ones up to its `last`, a
slice of the array. Rows, cells, options and the like are numbered among their own kind besides, so that those of a row or a
table are a slice of these. The page's text is one string, and an element's text is a part of it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of pages whose elements are held at once in a task.
HELD_BYTES = 4 << 20
# Elements without an end, with a text that isn't markup, and those that end open ones of these names, up to the element they belong to.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style"])
IMPLIED = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "select": (("select",), ()), "tr": (("td", "th", "tr"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: What is numbered, by its name, and what of it an element counts inside itself: two kinds at most, others count list items.
NUMBERED = {"td": "cell", "th": "cell", "option": "option", "dt": "dt", "dd": "dd", "li": "li", "tr": "tr"}
COUNTED = {"tr": ("cell", "tr"), "select": ("option", "tr"), "dl": ("dt", "dd"), "table": ("tr", "tr")}
FIELDS = ["last", "up", "start", "end", "inner", "first", "past", "first2", "past2"]
KIND = f"array<struct<pre:int,name:string,attrs:string,tabled:boolean,{','.join(f + ':int' for f in FIELDS)}>>"


def sweep(html: str) -> tuple[str, list[tuple[str, str, bool]], list[list[int]]]:
    """The page's text; of each element name, attributes and whether it is in a table, and its FIELDS.

    up is -1 for outermost ones; start and end are places in the text; inner counts elements right inside; first and past
    are the numbers of the first COUNTED element inside and of the first behind it.

    Comments, scripts and styles have no text. An end without a start is left; an element that isn't closed ends with the
    one around it, or where its kind of element can't go on.
    """
    texts, size, at = [], 0, 0
    named: list[tuple[str, str, bool]] = []
    place: list[list[int]] = []
    stack: list[int] = []
    open_: dict[str, int] = {}  # elements of each name on the stack: what isn't open isn't looked for

    numbers = dict.fromkeys(NUMBERED.values(), 0)

    def close(i: int) -> None:
        of, of2 = COUNTED.get(named[i][0], ("li", "tr"))
        place[i][0], place[i][3], place[i][6], place[i][8] = len(named) - 1, size, numbers[of], numbers[of2]
        open_[named[i][0]] -= 1

    while True:
        tag = _TAG.search(html, at)
        piece = html[at : tag.start() if tag else len(html)]
        if piece:
            piece = entities.unescape(piece)
            texts.append(piece)
            size += len(piece)
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if open_.get(name):
                while True:
                    i = stack.pop()
                    close(i)
                    if named[i][0] == name:
                        break
            continue
        if name in IMPLIED and any(open_.get(n) for n in IMPLIED[name][0]):
            ended, bounds = IMPLIED[name]
            depth = len(stack) - 1
            found = None
            while depth >= 0 and named[stack[depth]][0] not in bounds:
                if named[stack[depth]][0] in ended:
                    found = depth
                depth -= 1
            while found is not None and len(stack) > found:
                close(stack.pop())
        if stack:
            place[stack[-1]][4] += 1
        if name in NUMBERED:
            numbers[NUMBERED[name]] += 1
        of, of2 = COUNTED.get(name, ("li", "tr"))
        named.append((name, tag[3], open_.get("table", 0) > 0))
        place.append([len(named) - 1, stack[-1] if stack else -1, size, size, 0, numbers[of], numbers[of], numbers[of2], numbers[of2]])
        if name in VOID:
            continue
        if name in RAW:
            end = _ENDS[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(len(named) - 1)
        open_[name] = open_.get(name, 0) + 1
    while stack:
        close(stack.pop())
    return "".join(texts), named, place


def with_elements(pages: DataFrame, mark: str) -> DataFrame:
    """pages with elements and words, the page's text; both null for pages without `mark`, a pattern, and null pages."""
    names = [c for c in pages.columns if c not in ("elements", "words")]
    asked = re.compile(mark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(names.index("html"))
            upto = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
            at = 0
            while at < batch.num_rows:  # some MB of pages at a time
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + HELD_BYTES, "right")))
                texts, tags, places, sizes = [], [], [], []
                for page in html.slice(at, to - at).to_pylist():
                    if page is None or not asked.search(page):
                        texts.append(None)
                        sizes.append(0)
                        continue
                    text, named, place = sweep(page)
                    texts.append(text)
                    sizes.append(len(named))
                    tags += named
                    places += place
                p = np.array(places, np.int32).reshape(-1, len(FIELDS))
                pre = np.concatenate([np.arange(n) for n in sizes]).astype(np.int32) if sizes else np.zeros(0, np.int32)
                cols = [pa.array(pre), pa.array([t[0] for t in tags], pa.string()), pa.array([t[1] for t in tags], pa.string()), pa.array([t[2] for t in tags], pa.bool_())]
                cols += [pa.array(np.ascontiguousarray(p[:, i])) for i in range(len(FIELDS))]
                struct = pa.StructArray.from_arrays(cols, ["pre", "name", "attrs", "tabled", *FIELDS])
                none = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), struct, mask=none)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, lists, pa.array(texts, pa.string())], [*names, "elements", "words"])
                at = to

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*names).schema)
    return pages.select(*names).mapInArrow(run, f"{fields}elements {KIND}, words string")


def below(all_: Column, e: Column) -> Column:
    """All elements inside an element, in order."""
    return F.slice(all_, e["pre"] + 2, e["last"] - e["pre"])


def inner(all_: Column, e: Column) -> Column:
    """Elements right inside an element."""
    return F.filter(below(all_, e), lambda x: x["up"] == e["pre"])


def counted(numbered: Column, e: Column, second: bool = False) -> Column:
    """Of all elements of a kind that is COUNTED, those inside e."""
    first, past = (e["first2"], e["past2"]) if second else (e["first"], e["past"])
    return F.slice(numbered, first + 1, past - first)


def text_of(words: Column, e: Column) -> Column:
    """Text of an element and all inside it, without white space at its ends."""
    return F.regexp_replace(F.substring(words, e["start"] + 1, e["end"] - e["start"]), r"^\s+|\s+$", "")
