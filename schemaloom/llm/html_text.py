"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags. Each block has its word count and link density, those of the block
before and the block after it, and what its enclosing elements say. A decision tree fitted on a small labelled table tells
article text from the rest. Splits on markup count for less than splits on text (``markup_weight``): pages often have
none, or have it where it doesn't hold, so the tree asks words, links and neighbours first. One pass over the pages, no shuffle.

Edge cases: null and empty pages give the empty string; unclosed tags, comments and scripts run to the
end of the page or of their parent; a bare ``<`` is text; a tag whose quotes never close ends at its next ``>``, and quotes count
for nothing after it; nesting of any depth takes no recursion; any page takes time in proportion to its length; pages
with equal ids are treated one by one; clashing extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from schemaloom.llm.text import slices

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "inside", "outside")
MARKUP = ("inside", "outside")

# A small labelled table: what blocks of common page layouts look like, in the order of FEATURES; the last
# value says whether the block is article text. inside: the nearest telling element is the article or main
# part; outside: it is a menu, header, footer, sidebar, notice, advert, form or comment section.
LABELLED = (
    # Pages without telling elements. Running text, among running text and at its ends.
    (110, 0.0, 90, 0.0, 2, 1.0, 0, 0, 0, 1), (60, 0.0, 55, 0.0, 48, 0.0, 0, 0, 0, 1), (28, 0.0, 40, 0.0, 36, 0.1, 0, 0, 0, 1), (45, 0.2, 2, 1.0, 38, 0.0, 0, 0, 0, 1),
    (90, 0.1, 3, 1.0, 5, 1.0, 0, 0, 0, 1), (75, 0.0, 8, 0.0, 66, 0.0, 0, 0, 0, 1), (38, 0.05, 52, 0.0, 12, 0.0, 0, 0, 0, 1), (52, 0.0, 31, 0.0, 0, 0.0, 0, 0, 0, 1),
    (24, 0.1, 47, 0.0, 70, 0.0, 0, 0, 0, 1), (33, 0.0, 6, 0.0, 41, 0.0, 0, 0, 0, 1), (66, 0.3, 44, 0.1, 58, 0.1, 0, 0, 0, 1), (140, 0.0, 0, 0.0, 120, 0.0, 0, 0, 0, 1),
    (60, 0.0, 55, 0.0, 12, 0.0, 0, 0, 0, 1), (80, 0.0, 30, 0.0, 8, 0.0, 0, 0, 0, 1), (100, 0.0, 20, 0.0, 15, 0.0, 0, 0, 0, 1), (45, 0.0, 50, 0.0, 5, 0.0, 0, 0, 0, 1),
    (72, 0.1, 9, 0.0, 10, 0.1, 0, 0, 0, 1), (41, 0.0, 12, 0.0, 18, 0.0, 0, 0, 0, 1), (95, 0.0, 40, 0.0, 5, 0.0, 0, 0, 0, 1), (58, 0.0, 3, 1.0, 9, 0.0, 0, 0, 0, 1),
    # Short lines of an article: what stands around them tells them from labels and teasers.
    (5, 0.0, 44, 0.0, 61, 0.0, 0, 0, 0, 1), (8, 0.0, 35, 0.0, 50, 0.0, 0, 0, 0, 1), (12, 0.0, 20, 0.0, 33, 0.0, 0, 0, 0, 1), (1, 0.0, 58, 0.0, 40, 0.0, 0, 0, 0, 1),
    (3, 0.0, 72, 0.0, 29, 0.0, 0, 0, 0, 1), (14, 0.1, 39, 0.0, 45, 0.0, 0, 0, 0, 1), (6, 0.0, 2, 1.0, 55, 0.0, 1, 0, 0, 1), (7, 0.0, 3, 0.0, 80, 0.0, 1, 0, 0, 1),
    (4, 0.0, 62, 0.0, 48, 0.0, 1, 0, 0, 1), (9, 0.0, 1, 1.0, 35, 0.0, 1, 0, 0, 1), (2, 1.0, 49, 0.0, 53, 0.0, 0, 0, 0, 1), (4, 0.75, 64, 0.0, 37, 0.0, 0, 0, 0, 1),
    # Menus, link lists, teasers, labels and imprints.
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (4, 0.8, 5, 0.9, 60, 0.0, 0, 0, 0, 0),
    (25, 0.9, 12, 1.0, 14, 0.9, 0, 0, 0, 0), (40, 0.7, 20, 0.8, 18, 0.8, 0, 0, 0, 0), (30, 1.0, 26, 1.0, 28, 1.0, 0, 0, 0, 0), (5, 1.0, 70, 0.0, 6, 1.0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.0, 2, 0.0, 3, 0.0, 0, 0, 0, 0), (6, 0.5, 60, 0.0, 4, 1.0, 0, 0, 0, 0), (3, 0.0, 4, 1.0, 2, 1.0, 1, 0, 0, 0),
    (16, 0.3, 4, 1.0, 15, 0.3, 0, 0, 0, 0), (14, 0.2, 17, 0.3, 3, 1.0, 0, 0, 0, 0), (9, 0.0, 66, 0.0, 0, 0.0, 0, 0, 0, 0), (11, 0.1, 54, 0.0, 2, 1.0, 0, 0, 0, 0),
    (8, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0), (7, 0.0, 3, 1.0, 9, 0.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (10, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 12, 0.3, 1, 0, 0, 0), (3, 0.0, 50, 0.0, 2, 1.0, 1, 0, 0, 0), (6, 0.0, 5, 0.0, 4, 0.0, 0, 0, 0, 0), (13, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0),
    # Between link lists: running text by its length, labels and teasers.
    (55, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (35, 0.05, 4, 1.0, 1, 1.0, 0, 0, 0, 1), (70, 0.1, 1, 1.0, 2, 1.0, 0, 0, 0, 1), (48, 0.0, 3, 1.0, 5, 0.9, 0, 0, 0, 1),
    (16, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (20, 0.1, 1, 1.0, 4, 1.0, 0, 0, 0, 0), (30, 0.5, 25, 0.5, 28, 0.5, 0, 0, 0, 0), (22, 0.4, 20, 0.4, 24, 0.4, 0, 0, 0, 0),
    (42, 0.6, 3, 1.0, 40, 0.6, 0, 0, 0, 0), (36, 0.8, 2, 1.0, 1, 1.0, 0, 0, 0, 0), (18, 0.9, 60, 0.0, 16, 0.9, 0, 0, 0, 0), (50, 0.5, 48, 0.5, 44, 0.5, 0, 0, 0, 0),
    # Within an article or main part: its text of any length.
    (40, 0.0, 1, 1.0, 2, 1.0, 0, 1, 0, 1), (65, 0.1, 3, 1.0, 4, 0.9, 0, 1, 0, 1), (22, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 1), (15, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1),
    (6, 0.0, 1, 1.0, 2, 1.0, 1, 1, 0, 1), (8, 0.0, 4, 1.0, 3, 1.0, 0, 1, 0, 1), (31, 0.3, 12, 0.5, 25, 0.4, 0, 1, 0, 1), (17, 0.6, 20, 0.5, 22, 0.3, 0, 1, 0, 1),
    (60, 0.0, 55, 0.0, 48, 0.0, 0, 1, 0, 1), (35, 0.1, 60, 0.0, 20, 0.0, 0, 1, 0, 1), (1, 0.0, 50, 0.0, 80, 0.0, 0, 1, 0, 1), (3, 0.0, 2, 0.0, 4, 0.0, 0, 1, 0, 1),
    (9, 0.0, 4, 1.0, 70, 0.0, 1, 1, 0, 1), (2, 0.0, 1, 1.0, 1, 0.0, 1, 1, 0, 1), (4, 0.5, 40, 0.0, 44, 0.0, 0, 1, 0, 1), (2, 1.0, 60, 0.0, 52, 0.0, 0, 1, 0, 1),
    (120, 0.05, 8, 0.0, 6, 0.9, 0, 1, 0, 1), (6, 0.0, 90, 0.0, 12, 0.2, 0, 1, 0, 1), (25, 0.9, 30, 0.0, 41, 0.0, 0, 1, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (5, 0.0, 60, 0.0, 2, 1.0, 0, 1, 0, 1), (30, 0.0, 40, 0.0, 3, 0.9, 0, 1, 0, 1), (2, 0.0, 3, 0.0, 5, 0.8, 1, 1, 0, 1), (50, 0.1, 45, 0.0, 1, 1.0, 0, 1, 0, 1),
    (7, 0.0, 6, 0.0, 9, 0.0, 0, 1, 0, 1), (12, 0.0, 66, 0.0, 10, 0.0, 0, 1, 0, 1), (18, 0.0, 5, 0.0, 3, 0.0, 0, 1, 0, 1), (11, 0.0, 70, 0.0, 13, 0.0, 0, 1, 0, 1),
    (8, 0.0, 2, 1.0, 7, 0.0, 1, 1, 0, 1), (1, 0.0, 1, 0.0, 2, 0.0, 0, 1, 0, 1), (4, 0.0, 7, 0.0, 31, 0.0, 0, 1, 0, 1), (10, 0.0, 30, 0.0, 5, 0.0, 0, 1, 0, 1),
    (5, 0.0, 1, 1.0, 2, 0.0, 1, 1, 0, 1), (3, 0.0, 4, 1.0, 12, 0.0, 0, 1, 0, 1), (2, 0.0, 33, 0.0, 11, 0.0, 0, 1, 0, 1), (20, 1.0, 5, 0.0, 24, 1.0, 0, 1, 0, 1),
    # Within it, but not of it: bars of tags and shares, lists of further pages.
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 1, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 1, 0, 0), (4, 1.0, 5, 1.0, 3, 1.0, 0, 1, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0),
    # Within menus, headers, footers, sidebars, notices, adverts, forms and comment sections.
    (70, 0.0, 66, 0.0, 58, 0.0, 0, 0, 1, 0), (30, 0.0, 12, 0.0, 50, 0.0, 0, 0, 1, 0), (8, 0.0, 3, 1.0, 11, 0.0, 0, 0, 1, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0),
    (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 1, 0), (14, 0.1, 80, 0.0, 0, 0.0, 0, 0, 1, 0), (5, 0.0, 60, 0.0, 7, 1.0, 1, 0, 1, 0), (45, 0.4, 9, 0.0, 7, 0.0, 0, 0, 1, 0),
    (100, 0.0, 20, 0.0, 15, 0.0, 0, 0, 1, 0), (6, 0.0, 0, 0.0, 3, 1.0, 1, 0, 1, 0), (3, 0.0, 4, 0.0, 90, 0.0, 0, 0, 1, 0), (22, 1.0, 16, 1.0, 18, 1.0, 0, 0, 1, 0),
    (80, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1, 0), (95, 0.0, 40, 0.0, 5, 0.0, 0, 0, 1, 0), (75, 0.2, 60, 0.0, 10, 0.5, 0, 0, 1, 0), (20, 0.0, 20, 0.0, 30, 0.0, 0, 0, 1, 0),
    (9, 0.0, 80, 0.0, 75, 0.0, 0, 0, 1, 0), (7, 0.0, 2, 1.0, 40, 0.0, 1, 0, 1, 0), (35, 0.0, 62, 0.0, 57, 0.0, 0, 0, 1, 0), (12, 0.0, 1, 1.0, 8, 0.0, 0, 0, 1, 0),
    (10, 0.0, 45, 0.0, 0, 0.0, 0, 0, 1, 0), (2, 0.0, 55, 0.0, 48, 0.0, 0, 0, 1, 0), (60, 0.0, 3, 1.0, 9, 0.0, 0, 0, 1, 0), (4, 0.0, 38, 0.0, 64, 0.0, 1, 0, 1, 0),
)


@dataclass(frozen=True)
class Node:
    """A leaf has no feature; ``keep`` is the share of article blocks in it."""

    keep: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit_tree(table=LABELLED, depth: int = 9, markup_weight: float = 0.4) -> Node:
    """A binary decision tree by Gini impurity; what a split on markup gains counts ``markup_weight`` times. Ties go to the
    first feature and the lowest threshold."""
    data = np.array(table, dtype=float)
    x, y = data[:, :-1], data[:, -1]
    worth = [markup_weight if name in MARKUP else 1.0 for name in FEATURES]

    def grow(rows: np.ndarray, left: int) -> Node:
        keep = y[rows].mean()
        best, whole = (-1e-9, -1, 0.0), len(rows) * keep * (1 - keep)
        for f in range(x.shape[1]) if left and 0 < keep < 1 else ():
            values = np.unique(x[rows, f])
            for at in (values[1:] + values[:-1]) / 2:
                low = y[rows[x[rows, f] < at]]
                high = y[rows[x[rows, f] >= at]]
                cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (low, high))
                best = min(best, (worth[f] * (cost - whole), f, at))
        _, f, at = best
        if f < 0:
            return Node(keep)
        return Node(keep, f, at, grow(rows[x[rows, f] < at], left - 1), grow(rows[x[rows, f] >= at], left - 1))

    return grow(np.arange(len(y)), depth)


def kept(tree: Node, features: tuple[float, ...]) -> bool:
    while tree.feature >= 0:
        tree = tree.low if features[tree.feature] < tree.at else tree.high
    return tree.keep >= 0.5


# Element names of HTML, by what they do to the text around them.
_UNREAD = "script|style|noscript|template|textarea|select|button|iframe|svg|canvas|object|title|math|video|audio"
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("body div section article main nav header footer aside form ul ol dl table tbody tr td th fieldset figure blockquote center details dialog menu p li h1 h2 h3 h4 h5 h6".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTSIDE = frozenset("nav footer aside form menu dialog".split())
# Words of class, id and role names of what is not article text.
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent notice notices alert popup modal "
    "overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs footer masthead toolbar share sharing social related recommended "
    "widget pagination pager search form copyright legal disclaimer skip complementary contentinfo".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist commentarea respond reply replies disqus discussion".split())
_IN_WORDS = frozenset("article main content post entry story".split())

_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE) for name in _UNREAD.split("|")}


class _Tags:
    """The tags of a page in order, in time linear in its length: (start, end, closing, name, attributes)."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def _end(self, at: int) -> int:
        """Where the tag's attributes end; -1 if there is no ``>`` left."""
        page = self.page
        first = page.find(">", at)
        if first < 0 or not self.quotes:
            return first
        here = at
        while True:
            here = _PLAIN.match(page, here).end()
            if here == len(page):
                break
            if page[here] == ">":
                return here
            here = page.find(page[here], here + 1) + 1
            if not here:
                break
        self.quotes = False  # some quote never closes
        return first

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        page, at = self.page, self.page.find("<")
        while at >= 0:
            m = _START.match(page, at)
            if m:
                stop = self._end(m.end())
                if stop < 0:
                    return
                name, rest = m[2].lower(), page[m.end() : stop]
                end = stop + 1
                if name in _CLOSE and not m[1] and not rest.endswith("/"):
                    close = _CLOSE[name].search(page, end)
                    yield at, close.end() if close else len(page), False, "", ""
                    at = page.find("<", close.end()) if close else -1
                    continue
                yield at, end, bool(m[1]), name, rest
            elif page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                end = stop + 3 if stop >= 0 else len(page)
                yield at, end, False, "", ""
            elif page.startswith(("<!", "<?"), at):
                stop = page.find(">", at)
                if stop < 0:
                    return
                end = stop + 1
                yield at, end, False, "", ""
            else:
                end = at + 1
            at = page.find("<", end)


_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


def _says(tag: str, rest: str, inside_article: bool) -> str:
    """What an element says of its text: in, out, comment, or nothing."""
    words: set[str] = set()
    if rest and ("=" in rest or "hidden" in rest.lower()):
        for name, *values in _NAMES.findall(rest):
            value = "".join(values).lower()
            if name.lower() == "hidden" or name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "out"
            if name.lower() != "style":
                words |= {*re.split(r"[\s_-]+", value)}
    if words & _COMMENT_WORDS:
        return "comment"
    if tag in ("article", "main"):
        return "out" if words & _OUT_WORDS else "in"
    if tag in _OUTSIDE or words & _OUT_WORDS or tag == "header" and not inside_article or "header" in words and not inside_article:
        return "out"
    return "in" if words & _IN_WORDS and tag not in _HEADINGS else ""


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, heading, inside, outside) of each flat block that has a word."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, str]] = []  # element, what holds inside it
    text: list[str] = []
    link: list[str] = []
    in_link, heading, place = 0, 0, ""

    def flush() -> None:
        words = "".join(text).split()
        if words:
            out.append((" ".join(words), len(words), min(len(words), sum(len(x.split()) for x in link)), heading, int(place == "in"), int(place in ("out", "comment"))))
        text.clear()
        link.clear()

    def add(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if in_link:
                link.append(raw)

    done, opened = 0, Counter()
    for start, end, closing, tag, rest in _Tags(page):
        add(page[done:start])
        done = end
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        in_link = 0 if tag in _CONTAINERS else in_link
        if tag not in _CONTAINERS or rest.endswith("/"):
            continue
        if closing:
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
        else:
            if stack and stack[-1][0] in ("p", *_HEADINGS):  # these end where the next block begins
                opened[stack.pop()[0]] -= 1
            if tag == "li" and stack and stack[-1][0] == "li":
                opened[stack.pop()[0]] -= 1
            above = stack[-1][1] if stack else ""
            said = _says(tag, rest, above == "in")
            stack.append((tag, "comment" if above == "comment" else said or above))
            opened[tag] += 1
        place = stack[-1][1] if stack else ""
        heading = int(bool(stack) and stack[-1][0] in _HEADINGS)
    add(page[done:])
    flush()
    return out


def features(found: list[tuple[str, int, int, int, int, int]]) -> list[tuple[float, ...]]:
    """FEATURES of each block; before the first and after the last there are no words."""
    around = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], *b[3:]) for i, b in enumerate(found)]


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, x in zip(found, features(found)) if kept(tree, x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length of every page."""
    tree = fit_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x or "", tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
