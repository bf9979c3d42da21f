"""A page as elements in document order, and a few selectors on them: for markup that SQL patterns can't tell apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=['\"]?([^'\"\]]*)['\"]?)?\]|:(last-child)", re.I)


class Element:
    def __init__(self, name: str, attrs: dict[str, str], up: Element | None):
        self.name, self.attrs, self.up = name, attrs, up
        self.inside: list[Element | str] = []
        self.classes = frozenset(attrs.get("class", "").split())

    def below(self) -> Iterator[Element]:
        """All elements inside, in document order."""
        left = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while left:
            e = left.pop()
            yield e
            left += [x for x in reversed(e.inside) if isinstance(x, Element)]

    def text(self) -> str:
        out, left = [], [self]
        while left:
            e = left.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.name not in ("script", "style"):
                left += reversed(e.inside)
        return "".join(out).strip()

    def is_like(self, simple: str) -> bool:
        for name, id_, cls, attr, value, last in _SIMPLE.findall(simple):
            if name and name.lower() != self.name or id_ and self.attrs.get("id") != id_ or cls and cls not in self.classes:
                return False
            if attr and (attr not in self.attrs or value and self.attrs[attr] != value):
                return False
            if last and self.up is not None and [x for x in self.up.inside if isinstance(x, Element)][-1] is not self:
                return False
        return True

    def fits(self, steps: list[str]) -> bool:
        """Whether it is like the last step, and elements around it like the others, in turn."""
        if not self.is_like(steps[-1]):
            return False
        around, rest = self.up, steps[:-1]
        while rest and around is not None:
            if around.is_like(rest[-1]):
                rest = rest[:-1]
            around = around.up
        return not rest

    def select(self, selector: str) -> list[Element]:
        """Elements inside, in document order, that fit a selector: simple ones, descendants, commas."""
        ways = [way.split() for way in selector.split(",")]
        return [e for e in self.below() if any(e.fits(w) for w in ways)]


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.inside.append(e)
        if tag not in VOID:
            self.now = e

    def handle_endtag(self, tag):
        e = self.now
        while e.up is not None and e.name != tag:
            e = e.up
        if e.up is not None:  # an end without a start is left
            self.now = e.up

    def handle_data(self, data):
        self.now.inside.append(data)


def read(html: str | None) -> Element:
    """The root of a page; unclosed elements end with the one around them."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root
