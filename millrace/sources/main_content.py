"""The main content of a page: text and link density by block, the best run of blocks by a maximum-sum scan, tables kept.

A page is walked once; each block element (paragraph, heading, list item, table row, …) gives its text, the share of it inside links, and
whether page furniture (navigation, footer, form, …) holds it.  A block scores its characters, less those in links several times
over, less a fixed cost; furniture scores below nothing.  The run of blocks with the greatest sum is the content: a short paragraph between
long ones stays, menus before and after do not.  A page without such a run gives "", and callers fall back to plainer text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources import parsers

SILENT = frozenset({"script", "style", "noscript", "template", "svg", "head"})
FURNITURE = frozenset({"nav", "footer", "header", "aside", "form", "menu", "button", "select"})
BLOCKS = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "tr", "dt", "dd", "figcaption", "caption", "div", "section", "article", "main", "td", "th", "ul", "ol", "table", "body"})
VOID = frozenset({"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "source", "wbr", "embed", "track"})
#: A block costs so much, a character inside a link counts so often against it, and a block of furniture scores so much.
COST, LINKED, OUTSIDE, LEAST = 20, 3, -60, 80
_NAMED = re.compile(r"(?i)\b(nav|menu|footer|sidebar|cookie|banner|breadcrumb|share|social|advert|promo|related|newsletter)")


class Block:
    """Text of a block element, its characters inside links, and whether furniture holds it."""

    def __init__(self, furniture: bool):
        self.parts, self.linked, self.furniture = [], 0, furniture

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    def score(self) -> int:
        size = len(self.text)
        return min(OUTSIDE, -size // 4) if self.furniture else size - LINKED * min(self.linked, size) - COST


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.now = [], [], None

    def _inside(self, names) -> bool:
        return any(tag in names for tag, _ in self.stack)

    def _new(self) -> None:
        if self.now and self.now.text:
            self.blocks.append(self.now)
        self.now = Block(any(marked for _, marked in self.stack))

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr") and self.now:
                self.now.parts.append(" ")
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        cell = tag in ("td", "th") or (self._inside({"td", "th"}) and tag in ("p", "div"))
        self.stack.append((tag, tag in FURNITURE or (tag not in ("body", "main", "article") and bool(_NAMED.search(named)))))
        if cell and self.now:
            self.now.parts.append(" | " if tag in ("td", "th") and self.now.text else " ")
        elif tag in BLOCKS or self.stack[-1][1]:
            self._new()

    def handle_endtag(self, tag):
        if tag in VOID or not any(t == tag for t, _ in self.stack):
            return
        marked = False
        while self.stack:
            t, m = self.stack.pop()
            marked = marked or m
            if t == tag:
                break
        if (tag in BLOCKS and tag not in ("td", "th") and not self._inside({"td", "th"})) or marked:
            self._new()

    def handle_data(self, data):
        if self._inside(SILENT):
            return
        if self.now is None:
            self._new()
        self.now.parts.append(data)
        if self._inside({"a"}):
            self.now.linked += len("".join(data.split()))


def blocks(page: str) -> list[Block]:
    walk = _Walk()
    walk.feed(page)
    walk.close()
    walk._new()
    return walk.blocks


def best_run(scores: list[int]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest sum (the first one, and the shortest); (0, 0) if none is above 0."""
    best, at, total, start = 0, (0, 0), 0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0, k
        total += s
        if total > best:
            best, at = total, (start, k + 1)
    return at


def main_content(page: str | None) -> str:
    """Lines of the best run of blocks, furniture inside it left out; "" where it is shorter than ``LEAST`` characters."""
    found = blocks(page or "")
    lo, hi = best_run([b.score() for b in found])
    text = "\n".join(b.text for b in found[lo:hi] if not b.furniture)
    return text if len(text) >= LEAST else ""


def extracted(page: str | None) -> tuple[str, str]:
    """(text, way): the main content; else all text of the page's elements without furniture; else the page without its tags."""
    if text := main_content(page):
        return text, "main"
    if text := parsers.html((page or "").encode()).strip():
        return text, "elements"
    return " ".join(re.sub(r"<[^>]+>", " ", page or "").split()), "stripped"


def with_content(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, content and way of each page; a null page has an empty content."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extracted(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [key, "content", "way"])

    return pages.select(F.col(key), F.col(html)).mapInArrow(run, f"{key} {kind}, content string, way string")
