"""A small element list for one HTML page, for rules that need nesting."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa

#: Pages whose texts are handed back at once.
PAGES_AT_ONCE = 100

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_STEP = re.compile(r"(?P<tag>[a-z0-9]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>[*]?=)'?(?P<value>[^'\]]*)'?)?\]")


@dataclass
class Element:
    """An element; its descendants are the elements from ``index + 1`` up to ``end``."""

    index: int
    tag: str
    attrs: dict[str, str]
    parent: int
    end: int = -1
    text_from: int = 0
    text_to: int = -1
    classes: frozenset[str] = field(default_factory=frozenset)


class Page(HTMLParser):
    """Elements and visible text pieces of a page in document order."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        self._open: list[Element] = []
        self._open_tags: Counter[str] = Counter()
        self._in_piece = False
        self.feed(html or "")
        self.close()
        while self._open:
            self._finish(self._open.pop())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._in_piece = False
        values = {name: value or "" for name, value in attrs}
        parent = self._open[-1].index if self._open else -1
        element = Element(len(self.elements), tag, values, parent, text_from=len(self.pieces))
        element.classes = frozenset(values.get("class", "").split())
        self.elements.append(element)
        if tag in _VOID:
            self._finish(element)
        else:
            self._open.append(element)
            self._open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._in_piece = False
        while self._open_tags[tag]:
            element = self._open.pop()
            self._open_tags[element.tag] -= 1
            self._finish(element)
            if element.tag == tag:
                break

    def handle_comment(self, data: str) -> None:
        self._in_piece = False

    def handle_data(self, data: str) -> None:
        if any(self._open_tags[tag] for tag in _HIDDEN):
            return
        if self._in_piece:
            self.pieces[-1] += data
        else:
            self.pieces.append(data)
            self._in_piece = True

    def _finish(self, element: Element) -> None:
        element.end = len(self.elements)
        element.text_to = len(self.pieces)

    def text(self, element: Element) -> str:
        return " ".join(" ".join(self.pieces[element.text_from : element.text_to]).split())

    def ancestors(self, element: Element):
        while element.parent >= 0:
            element = self.elements[element.parent]
            yield element

    def nearest(self, class_name: str) -> list[Element | None]:
        """For every element the closest element around it that has the class."""
        found: list[Element | None] = []
        for element in self.elements:
            parent = self.elements[element.parent] if element.parent >= 0 else None
            if parent is None or class_name in parent.classes:
                found.append(parent)
            else:
                found.append(found[parent.index])
        return found

    def select(self, selectors: str, within: Element | None = None) -> list[Element]:
        """Elements matching any of the comma-separated selectors (tags, classes, attributes, nesting)."""
        chains = [
            [list(_STEP.finditer(step)) for step in selector.split()] for selector in selectors.split(",")
        ]
        scope = self.elements if within is None else self.elements[within.index + 1 : within.end]
        return [e for e in scope if any(self._matches(e, chain) for chain in chains)]

    def first(self, selectors: str, within: Element | None = None) -> Element | None:
        return next(iter(self.select(selectors, within)), None)

    def _matches(self, element: Element, chain: list) -> bool:
        *outer, last = chain
        if not _fits(element, last):
            return False
        for ancestor in self.ancestors(element):
            if not outer:
                break
            if _fits(ancestor, outer[-1]):
                outer = outer[:-1]
        return not outer


def first_texts(batches: Iterator[pa.Array], rules: Sequence[str], max_chars: int) -> Iterator[pa.Array]:
    """For every page the text of its first element, in the order of the rules, that has any.

    One page at a time is a string, and the texts of a few pages; the rest stays in the batches as they come.
    """
    for batch in batches:
        for start in range(0, len(batch), PAGES_AT_ONCE):
            sources = (page.as_py() for page in batch.slice(start, PAGES_AT_ONCE))
            yield pa.array([None if s is None else _first_text(s, rules, max_chars) for s in sources], pa.string())


def _first_text(source: str, rules: Sequence[str], max_chars: int) -> str:
    page = Page(source)
    for rule in rules:
        for element in page.select(rule):
            text = page.text(element)
            if text:
                return text[:max_chars]
    return ""


def mark_of(selector: str) -> str:
    """A word that any page with a match for the selector must contain."""
    *_, last = selector.split()
    parts = list(_STEP.finditer(last))
    for group in ("value", "cls", "name", "tag"):
        for part in parts:
            if part[group]:
                return part[group]
    return last


def _fits(element: Element, step: list) -> bool:
    for part in step:
        if part["tag"] and element.tag != part["tag"]:
            return False
        if part["cls"] and part["cls"] not in element.classes:
            return False
        if part["name"]:
            value = element.attrs.get(part["name"])
            if value is None:
                return False
            if part["op"] == "=" and value != part["value"]:
                return False
            if part["op"] == "*=" and part["value"] not in value:
                return False
    return True
