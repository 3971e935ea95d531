"""Main text of HTML pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mapped

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?|["'][^"']*+""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes"}
"""Elements without markup or readable text inside: skipped to their end tag, or else to the end of the page."""
FALLBACK = {"noscript", "template", "audio", "video", "canvas"}
"""Skipped to their end tag; without one the tag alone is."""
MUTED = {"button", "select", "svg"}
"""Inline controls: text is left out until the end tag or the next block."""
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp"}
CLOSED_BY = {"li": {"li"}, "p": BLOCK, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
"""Open elements that a start tag ends."""
MAIN = {"article", "main"}
ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu", "search", "fieldset"}
ASIDE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
SECTIONS = MAIN | ASIDE | {"header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT_TAGS = {"p", "blockquote", "pre", "td", "dd", "figcaption", "xmp"}
# Parts of class names and ids.
REMARKS = {"comment", "comments", "disqus", "respond", "responses", "reply", "replies", "thread", "commenter"}
ASIDE_WORDS = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe", "signup", "login", "popup", "modal", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "masthead"}
FRAME_WORDS = {"box", "block", "section", "area", "wrapper", "wrap", "container", "bar", "top", "bottom", "left", "right", "main", "site", "page", "primary", "secondary", "posts", "links", "articles", "slot", "unit", "div", "gpt", "dfp", "google", "message", "text", "content", "inner", "outer"}
"""Parts that leave the meaning of the word beside them as it is."""
PRAISE = {"article", "content", "entry", "post", "story", "body", "main", "text"}

# The classifier: a block's log-odds of being content. The weights are fixed, as no labelled pages exist, and leave short blocks near
# zero, so that their neighbours decide.
BIAS, IN_MAIN, TEXT_TAG, HEADING, LIST_ITEM, LINKS, LINKS_IN_MAIN, LENGTH, SENTENCE, PRAISED = -1.2, 1.2, 0.8, -0.8, 0.8, -4.0, -1.0, 0.8, 0.6, 0.8
HEADER, IN_ASIDE, REMARK, ASIDE_NAME, ASIDE_PART, ASIDE_PART_IN_MAIN, HIDDEN = -4.0, -6.0, -5.0, -5.0, -1.5, -0.3, -50.0
"""Page headers; elements and roles of ASIDE; names with a word of REMARKS; names with two of ASIDE_WORDS or made up of one and
FRAME_WORDS; other names with one of ASIDE_WORDS, outside and inside of an article; hidden elements."""
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
"""Letters of scripts that are written without spaces: UNSPACED_WORD of them count as a word."""
UNSPACED_WORD = 2.0
STOPS = ".!?…\"»”:;。！？｡」』）؟۔।॥።"
NEXT, DECAY, FAR = 1.2, 0.45, 8
"""Capacity between neighbours in page order with one parent, and what each further step through the tree leaves of it. Borders of
SECTIONS and of elements named as aside count SECTION_STEPS; from FAR steps on there is no edge."""
SECTION_STEPS = 3
SIBLING = 0.4
"""Capacity between a block and the last one before it with its tag and parent, if others are between them."""
WHOLE_SHARE = 0.6
"""The name of an element that wraps the page, with more of the open text than this and an article or nearly all text, says nothing."""


@dataclass(eq=False, slots=True)
class Element:
    tag: str
    parent: Element | None
    depth: int = 0
    aside: float = 0.0  # by tag, role and visibility, with those around it
    named: float = 0.0  # by class and id, alone
    remark: bool = False
    in_main: bool = False
    in_header: bool = False
    in_item: bool = False
    praised: bool = False
    has_main: bool = False
    text: int = 0


@dataclass(eq=False, slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(tag: str, attrs: str, parent: Element) -> Element:
    e = Element(tag, parent, parent.depth + 1, min(parent.aside, IN_ASIDE) if tag in ASIDE else parent.aside)
    e.in_main, e.in_item = parent.in_main or tag in MAIN, parent.in_item or tag == "li"
    e.in_header = not e.in_main and (parent.in_header or tag == "header")
    e.praised = parent.praised
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ASIDE_ROLE:
            e.aside = min(e.aside, IN_ASIDE)
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            e.aside = HIDDEN
        elif name in ("class", "id", "itemprop") and tag not in ("html", "body"):
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word) if not p.isdigit()}
                if not parts.isdisjoint(REMARKS):
                    e.named, e.remark = min(e.named, REMARK), True
                elif tag not in MAIN and not parts.isdisjoint(ASIDE_WORDS):
                    strong = parts <= ASIDE_WORDS | FRAME_WORDS or len(parts & ASIDE_WORDS) > 1
                    e.named = min(e.named, ASIDE_NAME if strong else ASIDE_PART_IN_MAIN if e.in_main else ASIDE_PART)
                e.praised |= not parts.isdisjoint(PRAISE)
    return e


def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:[\s/][^>]*+)?>", re.IGNORECASE)


_ENDS = {tag: _end_tag(tag) for tag in RAW | FALLBACK | {"xmp"}}


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's runs of text between block-level tags, references decoded, white space as one space, without empty ones; all elements."""
    root = Element("#", None)
    here, links, pos, n = root, 0, 0, page.rfind(">") + 1
    out: list[Block] = []
    elements = [root]
    block, muted = Block(root), ""
    opened: dict[str, int] = {}  # elements open now, by tag
    endless: set[str] = set()  # tags without an end tag further on

    def close() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                out.append(block)
        block = Block(here)

    def text(a: int, b: int, raw: bool = False) -> None:
        if a < b and not muted:
            part = html.unescape(page[a:b]) if not raw and "&" in page[a:b] else page[a:b]
            if not block.parts:
                block.element = here
            block.parts.append(part)
            if links:
                block.linked += len(" ".join(part.split()))

    def leave() -> None:
        nonlocal here
        opened[here.tag] -= 1
        here = here.parent

    while pos < n:
        m = _TAG.search(page, pos, n)
        if not m:
            break
        text(pos, m.start())
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCK:
                muted = ""
                close()
                if opened.get(tag):
                    while here.tag != tag:
                        leave()
                    leave()
                    block.element = here
            elif tag == muted:
                muted = ""
            elif tag == "a" and links:
                links -= 1
            continue
        attrs = m[3] or m[6] or ""
        if tag in _ENDS:
            end = None if tag in endless or attrs.endswith("/") else _ENDS[tag].search(page, pos, n)
            if tag == "xmp" and end:
                close()
                text(pos, end.start(), True)
                close()
            if end:
                pos = end.end()
                continue
            endless.add(tag)
            if tag in RAW and not attrs.endswith("/"):
                pos = n = len(page)
            continue
        if tag in MUTED:
            muted = muted or ("" if attrs.endswith("/") else tag)
        elif tag == "br":
            block.parts.append(" ")
        elif tag in BLOCK:
            muted = ""
            close()
            while here.parent and tag in CLOSED_BY.get(here.tag, ()):
                leave()
            if tag not in VOID:
                here = _element(tag, attrs, here)
                opened[tag] = opened.get(tag, 0) + 1
                elements.append(here)
            block.element = here
            links = 0
        elif tag == "a":
            links += 1
    text(pos, len(page))
    close()
    return out, elements


def minimum_cut(excess: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The nodes on the source's side of a minimum cut.

    excess is each node's capacity from the source less that to the sink (the common part flows straight through);
    edges have a capacity in both directions. Dinic's algorithm: levels by breadth-first search, then blocking flows.
    """
    n = len(excess)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for i, x in enumerate(excess):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if left[e] <= eps)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > eps and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, borders of sections counting more; FAR if there are as many or more."""
    steps = 0
    while a is not b and steps < FAR:
        if a.depth < b.depth:
            a, b = b, a
        steps += SECTION_STEPS if a.tag in SECTIONS or a.named <= ASIDE_NAME else 1
        a = a.parent
    return min(steps, FAR)


def scores(found: list[Block], elements: list[Element]) -> list[float]:
    """Each block's log-odds of being content by the linear classifier: what labelling it boilerplate costs more than labelling it content."""
    for b in found:
        if b.element.aside == 0:
            b.element.text += len(b.text)
    for e in reversed(elements):  # parents come before their children
        e.has_main |= e.tag in MAIN
        if e.parent:
            e.parent.text += e.text
            e.parent.has_main |= e.has_main
    total = elements[0].text
    names: dict[int, float] = {}
    for e in elements:
        whole = e.text > WHOLE_SHARE * total and (e.has_main or (not e.remark and e.text > 0.9 * total))
        names[id(e)] = min(names[id(e.parent)] if e.parent else 0.0, 0.0 if whole else e.named)
    out = []
    for b in found:
        e = b.element
        words = b.text.count(" ") + 1 + (0 if b.text.isascii() else len(_UNSPACED.findall(b.text)) / UNSPACED_WORD)
        links = LINKS_IN_MAIN if e.in_main else LINKS  # an article may hold lists of links and whole sentences that are one
        x = BIAS + LENGTH * math.log1p(words / 8) + links * min(1.0, b.linked / len(b.text)) + SENTENCE * (b.text[-1] in STOPS)
        x += IN_MAIN * e.in_main + PRAISED * e.praised + TEXT_TAG * (e.tag in TEXT_TAGS) + HEADING * (e.tag in HEADINGS) + LIST_ITEM * e.in_item
        out.append(x + HEADER * e.in_header + min(e.aside, names[id(e)]))
    return out


def smoothness(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, by their distance in the tree, and between siblings."""
    edges, last = [], {}
    for i, b in enumerate(found):
        parent = (id(b.element.parent or b.element), b.element.tag)
        if i:
            far = distance(found[i - 1].element, b.element)
            if far < FAR:
                edges.append((i - 1, i, NEXT * DECAY ** max(0, far - 2)))
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def label(found: list[Block], elements: list[Element]) -> list[bool]:
    """Which blocks are content: the labelling of least total cost."""
    return minimum_cut(scores(found, elements), smoothness(found))


def main_text(page: str | None) -> str:
    """The blocks labelled content, joined by newlines."""
    found, elements = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, label(found, elements), strict=True) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with out_col in place of html_col: each page's main text.

    Blocks are runs of text between block-level tags. A linear classifier gives the costs of labelling a block content or boilerplate, which
    become capacities to source and sink: its length, share of links, sentence end and tag, the article, header, list, navigation, form or
    aside around it, and the words in class names and ids. Blocks next to each other and siblings are joined by edges, stronger the nearer
    they stand in the tree; the minimum cut labels all blocks at once, so short blocks go with their neighbours.

    The whole page is used, in time linear in its length but for the flow; null, empty and textless pages give an empty text. Markup left
    open at the end of the page is closed there. Each row is taken by itself: repeated rows give equal texts, an empty table none. One map
    over the rows. A column of pages that is named out_col is replaced; other columns stay.
    """
    return mapped(pages, html_col, f"`{out_col}` string", lambda slab: [pa.array([main_text(x) for x in slab.column(html_col).to_pylist()], pa.string())], drop=(html_col,), limit=4 << 20)


def with_length(extracted: DataFrame) -> DataFrame:
    return extracted.withColumn("n_chars", F.char_length("text").cast("long"))
