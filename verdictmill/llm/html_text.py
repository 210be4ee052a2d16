"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path. Per path the length of its text and its
punctuation are summed up over its nodes; the text ratio (characters per node) and the punctuation ratio are
smoothed over the nodes in page order and fused into one score; a path's score is the median of its nodes'. Paths whose score reaches a
share of the text's mean score are content paths, and their nodes are the content nodes. To these are added the nodes
that short texts of an article have: those that stand directly in a container with content nodes (headings, list items, short
paragraphs), those between the first and the last content node unless they are links of a container without any, and a
headline of the first level before them.

Tags only exclude: what a menu, header, footer, sidebar, notice, advert, form, or comment element holds is read no further. A class,
id or role that says so and nothing else excludes too, and one that ends in such a thing or begins with such a kind (reader-comments, cookie-message); one
that says more leaves the decision to the ratios. Such words say nothing of
html, body, main and article, nor of an element that holds most of the text and all articles and headings of the first level.
Where nearly all content stands in article elements (or, without these, in main), what is outside of them goes.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of HTML: elements without content, elements whose content is raw text, elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that end an open element of the second kind when they start.
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}}
#: Elements that are never main text, and words of class, id or role that mark such elements.
ASIDE = frozenset("nav header footer aside form button select dialog menu label input svg canvas object audio video head".split())
#: Elements that words of class, id or role do not make aside.
WHOLE = frozenset("html body main article".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside rail header masthead topbar footer foot bottombar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search searchbox form comment comments commentlist disqus respond reply replies discussion share sharing social related "
    "recommended recommendations widget widgets toolbar pager pagination tags copyright legal disclaimer skip hidden complementary contentinfo".split()
)
#: Words that say so whatever stands beside them: what ends a name is the thing, what begins it is the kind of thing.
LAST = frozenset("ad ads advert adverts advertisement comment comments commentlist discussion replies reviews sidebar navbar popup modal disclaimer newsletter paywall".split())
FIRST = frozenset("ad ads advert advertisement cookie cookies consent gdpr comment comments disqus newsletter sponsored promo paywall".split())
#: Words that may stand beside MARKS in a name without changing what it says.
PLAIN = frozenset("site page main top bottom left right inner outer upper lower global local primary secondary bar area box block wrapper wrap container list item items link links button buttons section slot unit panel group row col column layer module region zone id".split())
#: Elements that a node stands directly in, for what is added to content nodes.
CONTAINERS = frozenset("html body div section article main td blockquote center #root".split())
#: Punctuation of running text.
STOPS = re.compile(r"[.,;:!?…。、，；：！？؟،]")
#: Each alternative ends at the page's end at the latest, and nothing is tried twice, so a page is read in linear time.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_LONG_REFERENCE = re.compile(r"&#[xX]?0*[0-9a-fA-F]{8,};?")
_SCOPE = ("table", "td", "th", "button", "object")
_LISTS = ("ul", "ol", "dl", "table", "select")


def _says(attributes: str) -> tuple[bool, bool, bool]:
    """Of an element's attributes: it is hidden; a name says that it is aside; a name says so among other things."""
    hidden = strict = weak = False
    for m in _MARK.finditer(attributes):
        value, name = m[2] or m[3] or m[4] or "", m[1].lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = [p.lower() for p in _PART.findall(token)]
                named = [p for p in parts if p not in PLAIN and not p.isdigit()]
                loud = bool(named) and (named[-1] in LAST or named[0] in FIRST)
                if loud or any(p in MARKS for p in parts):
                    only = loud or all(p in MARKS or p in PLAIN or p.isdigit() for p in parts)
                    strict, weak = strict or only, weak or not only
        else:
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", "")
    return hidden, strict, weak


class Page:
    """The elements of a page (name, parent, path, container, what excludes them) and its text nodes (element, block, text), in page order.

    Tags may be left open or closed wrongly. All lists are by number; parents have smaller numbers than their children.
    """

    def __init__(self, page: str):
        self.name, self.parent, self.path, self.container = ["#root"], [0], [0], [0]
        self.aside, self.strict, self.weak = [False], [False], [False]
        self.chief, self.link, self.article, self.main = [False], [False], [0], [0]
        self.element: list[int] = []
        self.block: list[int] = []
        self.text: list[str] = []
        self.spaced: list[bool] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [0]
        self._open: dict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []
        self._block = 0
        self._read(page)
        self._set_aside()

    def _cut(self, at: int) -> None:
        """Closes the elements from a place of the stack on."""
        while len(self._stack) > at:
            name = self.name[self._stack.pop()]
            self._open[name].pop()
            if name in BLOCK and name != "p":
                self._blocks.pop()

    def _push(self, name: str, attributes: str) -> None:
        up, n = self._stack[-1], len(self.name)
        hidden, strict, weak = _says(attributes) if attributes and not attributes.isspace() else (False, False, False)
        inside = self.article[up] or self.main[up]
        self.name.append(name)
        self.parent.append(up)
        self.path.append(self._paths.setdefault((self.path[up], name), len(self._paths) + 1))
        self.container.append(n if name in CONTAINERS else self.container[up])
        self.aside.append(self.aside[up] or hidden or name in ASIDE and not (name == "header" and inside))
        self.strict.append(strict and name not in WHOLE)
        self.weak.append(self.weak[up] or weak and name not in WHOLE)
        self.chief.append(self.chief[up] or name in ("article", "main", "h1"))
        self.link.append(self.link[up] or name == "a")
        self.article.append(self.article[up] or (n if name == "article" else 0))
        self.main.append(self.main[up] or (n if name == "main" else 0))
        self._open[name].append(len(self._stack))
        if name in BLOCK and name != "p":
            self._blocks.append(len(self._stack))
        self._stack.append(n)

    def _space(self) -> None:
        if self.text and self.block[-1] == self._block:
            self.spaced[-1] = True

    def _add(self, raw: str) -> None:
        if not raw or raw.isspace():
            self._space() if raw else None
            return
        self.element.append(self._stack[-1])
        self.block.append(self._block)
        self.text.append(html.unescape(_LONG_REFERENCE.sub("\ufffd", raw)))
        self.spaced.append(False)

    def _last(self, names: tuple[str, ...]) -> int:
        return max((self._open[x][-1] for x in names if self._open[x]), default=0)

    def _end(self, name: str) -> None:
        if at := self._open[name]:
            inner = bisect.bisect_right(self._blocks, at[-1]) < len(self._blocks)
            if name in BLOCK or not inner:
                self._cut(at[-1])

    def _start(self, name: str) -> None:
        """Closes what a start tag closes by itself."""
        if name in BLOCK and self._open["p"] and self._open["p"][-1] > self._last(_SCOPE):
            self._cut(self._open["p"][-1])
        if drop := IMPLIED.get(name):
            edge = self._last(_LISTS)
            firsts = [places[k] for x in drop if (places := self._open[x]) and (k := bisect.bisect_right(places, edge)) < len(places)]
            if firsts:
                self._cut(min(firsts))

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        while at < size:
            m = _TAG.search(page, at)
            if not m:
                self._add(page[at:])
                return
            self._add(page[at : m.start()])
            at = m.end()
            if m[1]:
                self._add(html.escape(m[1]))
            if not m[3]:
                continue
            name = m[3].lower()
            if name in BLOCK:
                self._block += 1
            if m[2]:
                self._space() if name == "br" else self._end(name)
                continue
            self._start(name)
            if name in VOID:
                self._space() if name == "br" else None
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            elif name in BLOCK or not m[4].rstrip().endswith("/"):
                self._push(name, m[4])

    def _set_aside(self) -> None:
        """Elements whose names say so are aside, but for those that hold most of the text and all of what is in article, main or h1
        elements: there the words tell of the page."""
        n = len(self.name)
        held, chief = [0] * n, [0] * n
        total = chiefs = 0
        for e, x in zip(self.element, self.text, strict=True):
            if not self.aside[e]:
                held[e] += len(x)
                chief[e] += self.chief[e]
                total, chiefs = total + len(x), chiefs + self.chief[e]
        for e in range(n - 1, 0, -1):
            held[self.parent[e]] += held[e]
            chief[self.parent[e]] += chief[e]
        for e in range(1, n):
            self.aside[e] = self.aside[e] or self.aside[self.parent[e]] or self.strict[e] and (2 * held[e] <= total or chief[e] < chiefs)


def path_scores(paths: np.ndarray, texts: list[str], width: float = 1.0) -> np.ndarray:
    """The score of each node's path: text and punctuation per node of the path, smoothed over the nodes and fused; the median of the path."""
    _, of = np.unique(paths, return_inverse=True)
    count = np.bincount(of)
    text = (np.bincount(of, [len(x.strip()) for x in texts]) / count)[of]
    mark = (np.bincount(of, [len(STOPS.findall(x)) for x in texts]) / count)[of]
    reach = max(1, round(3 * width))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    weight = np.convolve(np.ones(len(of)), kernel, "full")[reach:-reach]
    smooth = lambda v: np.convolve(v, kernel, "full")[reach:-reach] / weight
    fused = np.sqrt(smooth(text) * (1.0 + smooth(mark)))
    order = np.lexsort((fused, of))
    middle = np.cumsum(count) - count + (count - 1) // 2
    return fused[order][middle][of]


def content_nodes(page: Page, share: float = 0.25) -> list[int]:
    """The numbers of the text nodes that make the main text."""
    nodes = [k for k, e in enumerate(page.element) if not page.aside[e]]
    if not nodes:
        return []
    size = np.array([len(page.text[k].strip()) for k in nodes])
    scores = path_scores(np.array([page.path[page.element[k]] for k in nodes]), [page.text[k] for k in nodes])
    content = scores >= share * np.average(scores, weights=np.maximum(size, 1e-9))
    kept = _with_short_ones(page, nodes, content)
    for of in (page.article, page.main):
        inside = np.array([of[page.element[k]] > 0 for k in nodes])
        if (size * (content & inside)).sum() >= 0.8 * (size * content).sum():
            headed = any(_within(page, nodes[k], "h1") for k in np.flatnonzero(kept & inside))
            kept &= inside if headed else inside | np.array([_within(page, k, "h1") for k in nodes])
            break
    return [nodes[k] for k in np.flatnonzero(kept)]


def _within(page: Page, node: int, name: str) -> bool:
    e = page.element[node]
    return page.name[e] == name or page.name[page.parent[e]] == name


def _with_short_ones(page: Page, nodes: list[int], content: np.ndarray) -> np.ndarray:
    elements = [page.element[k] for k in nodes]
    home = [page.container[e] for e in elements]
    homes = {c for c, is_content in zip(home, content, strict=True) if is_content}
    around = set(homes)  # containers that have content nodes at any depth
    for c in homes:
        while c and (c := page.container[page.parent[c]]) not in around:
            around.add(c)
    first, last = np.flatnonzero(content)[[0, -1]]
    kept = content.copy()
    for k, e in enumerate(elements):
        if not content[k] and not page.weak[e]:
            beside = home[k] in homes
            between = first < k < last and not (page.link[e] and home[k] not in around)
            headline = k < first and _within(page, nodes[k], "h1")
            kept[k] = beside or between or headline
    return kept


def main_text(page: str) -> str:
    read = Page(page)
    blocks: dict[int, list[str]] = defaultdict(list)
    for k in content_nodes(read):
        blocks[read.block[k]] += (read.text[k], " ") if read.spaced[k] else (read.text[k],)
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without content, has the empty text. Null ids and urls stay; repeated rows are
    pages of their own; an empty table gives an empty result; further columns are not read.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            texts = [main_text(x) for x in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    ready = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return ready.mapInPandas(extract, "page_id long, url string, text string, n_chars long")
