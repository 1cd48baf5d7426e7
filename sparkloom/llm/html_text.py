"""Main text of web pages by composite text density.

One pass over the markup keeps a node for every element that a page shows, menus and adverts included: characters,
characters in links, tags, link tags.  A node's composite density is its characters per tag, adjusted by the balance of link and other characters with a logarithm
whose base grows with the page's share of links (Sun, Song and Liao, 2011).  A node's density sum is the sum over its
children.  Starting from the body, the threshold is the least density on the path from the body to the node with the
largest density sum; nodes at or above it are followed down to the subtree with the largest sum.  Elements that never
hold main text can't be chosen, and their text is left out of the chosen subtree's.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import need

TOKEN = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*)(?:>|\Z))", re.S)
SPACE = re.compile(r"\s+")
#: One attribute of a tag, whatever its name, with its value.
ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")

# fixed values: element names of the HTML standard
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "plaintext", "textarea", "title"}
#: Elements without any box of their own: the text around them is one block.
UNSEEN = {"script", "style", "noscript", "template", "link", "meta"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements without any text that a page shows; they are not counted.
MUTE = RAW | {"head", "svg", "math", "canvas", "object", "audio", "video", "datalist"}
#: Elements that hold no main text wherever they stand.
NEVER = MUTE | {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "input", "fieldset"}
#: Words in class, id or role that mark menus, notices, adverts and reader comments.
ASIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "consent", "cookie",
    "cookies", "disqus", "footer", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "respond", "search",
    "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that stand beside one of those in the name of a whole element ("site-footer", "related-posts-2"); in a name with
#: any other word ("search-results", "related-work", "ad-astra") the word marks nothing.
FRAME = {
    "area", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "desktop", "footer", "form", "global", "header", "icons", "inline", "inner", "item", "items",
    "left", "link", "links", "list", "main", "mobile", "outer", "overlay", "page", "policy", "posts", "primary", "right", "secondary", "section", "site", "slot", "sticky", "thread", "top",
    "unit", "wrap", "wrapper",
}
#: Start tags that close an open element of the names given, up to the nearest of the stops.
BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})} | {
    b: ({"p"}, {"div", "section", "article", "main", "body", "td", "th", "li", "blockquote", "table", "button", "object"}) for b in BLOCKS
}


class Node:
    __slots__ = ("tag", "parent", "kids", "start", "end", "chars", "tags", "link_chars", "link_tags", "sum", "most", "density", "out", "mute", "own", "linked", "inner")

    def __init__(self, tag: str, parent: Node | None, start: int, out: bool, mute: bool):
        self.tag, self.parent, self.start, self.end, self.out, self.mute = tag, parent, start, -1, out, mute
        self.kids: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own = 0  # characters that may be main text
        self.sum = self.most = self.density = 0.0
        # within a link; within an article or main element
        self.linked = tag == "a" or parent is not None and parent.linked
        self.inner = tag in ("article", "main") or parent is not None and parent.inner


def _aside(attributes: str) -> tuple[bool, bool]:
    """(marked as no main text, marked as a header) by an element's attributes."""
    header = False
    for m in ATTR.finditer(attributes):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True, False
        if name in ("class", "id", "role"):
            for token in value.split():
                words = {w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()}
                rest = words - ASIDE - FRAME
                if not rest and not ASIDE.isdisjoint(words):
                    return True, False
                header |= not rest and "header" in words
    return False, header


def parse(html: str) -> tuple[Node, list[tuple[str, bool, bool]]]:
    """The document's root and its text runs, in page order, as (text, whether a block starts before it, whether it may be main text).

    A node holds the runs from ``start`` to ``end``.
    """
    root = Node("#root", None, 0, False, False)
    node, runs, fresh, at, low = root, [], True, 0, None
    opened: Counter[str] = Counter()  # open elements by name, so that an end tag without one costs nothing

    def text(lo: int, hi: int) -> None:
        nonlocal fresh
        if lo < hi and not node.mute:
            runs.append((html[lo:hi], fresh, not node.out))
            length = len(SPACE.sub(" ", runs[-1][0]).strip())
            node.chars += length
            if not node.out:
                fresh = False
                node.own += length
            if node.linked:
                node.link_chars += length

    while m := TOKEN.search(html, at):
        text(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m.start() + 9, at - 3 if m[0].endswith("]]>") else at)
            continue
        block = name not in INLINE and name not in UNSEEN
        fresh |= block
        if m[1]:
            up = node if opened[name] else None
            while up is not None and up.tag != name:
                if up.tag in ("td", "th", "table", "article", "main", "section", "body") and name in INLINE | {"p", "li"}:
                    up = None
                    break
                up = up.parent
            if up is not None and up is not root:
                while node is not up.parent:
                    node.end = len(runs)
                    opened[node.tag] -= 1
                    node = node.parent
            continue
        if name in CLOSES:
            shut, stops = CLOSES[name]
            up = node if any(opened[x] for x in shut) else root
            while up is not root and up.tag not in stops and up.tag not in shut:
                up = up.parent
            if up.tag in shut:
                while node is not up.parent:
                    node.end = len(runs)
                    opened[node.tag] -= 1
                    node = node.parent
        marked, header = _aside(m[3]) if m[3].strip() and name not in ("html", "body", "article", "main") else (False, False)
        mute = node.mute or name in MUTE
        out = node.out or name in NEVER or marked
        if name == "header" or header and name not in INLINE:  # an article's own header may hold its heading
            out |= not node.inner
        if name in VOID or m[3].rstrip().endswith("/") and name not in RAW and name not in ("p", "div", "a", "b", "i", "li", "span"):
            if not mute:
                node.tags += 1
            continue
        kid = Node(name, node, len(runs), out, mute)
        node.kids.append(kid)
        if name in RAW:
            low = html.lower() if low is None and "</" in html else low or ""
            end = low.find(f"</{name}", at) if len(low) == len(html) else next((x.start() for x in re.compile(f"</{name}", re.I).finditer(html, at)), -1)
            if end < 0:
                end = len(html)
            kid.end = len(runs)
            close = html.find(">", end)
            at = len(html) if close < 0 else close + 1
            continue
        opened[name] += 1
        node = kid
    text(at, len(html))
    while node is not None:
        node.end = len(runs)
        node = node.parent
    return root, runs


def main_node(root: Node) -> Node:
    """The subtree with the largest density sum, by the thresholds of the path from the body."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if not k.mute]
    for n in reversed(order):
        for k in n.kids:
            if not k.mute:
                n.chars += k.chars
                n.own += k.own
                n.link_chars += k.link_chars
                n.tags += k.tags + 1
                n.link_tags += k.link_tags + (k.tag == "a")
    body = next((n for n in order if n.tag == "body"), root)
    if not body.own:
        body = root
    ratio = body.link_chars / max(body.chars, 1)

    def density(n: Node) -> float:
        if not n.chars:
            return 0.0
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        plain = max(c - n.link_chars, 1)
        base = log(c * n.link_chars / plain + ratio * c + 2.718281828459045)
        inner = c / lc * (t / lt)
        return c / t * max(log(max(inner, 1.0)) / base if base > 0 else 0.0, 1e-9)

    for n in order:
        n.density = density(n)
    for n in order:
        n.sum = sum(k.density for k in n.kids if not k.mute)
    for n in reversed(order):
        n.most = max(n.sum, max((k.most for k in n.kids if not k.out), default=0.0))
    inside, todo = [], [body]
    while todo:
        n = todo.pop()
        inside.append(n)
        todo += [k for k in n.kids if not k.out]
    best = max(inside, key=lambda n: (n.sum, n.own))
    threshold, up = best.density, best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    at = body
    while True:  # down to the largest sum, through nodes at or above the threshold
        down = [k for k in at.kids if not k.out and k.density >= threshold and k.own]
        top = max(down, key=lambda k: (k.most, k.own), default=None)
        if top is None or top.most < at.sum or top.tag in INLINE | {"p", "h1", "h2", "h3"}:
            return _article(at)
        at = top


def _article(n: Node) -> Node:
    """The article or main element around the chosen subtree, if there is one: its heading and lead belong to the text."""
    up = n
    while up is not None:
        if up.tag in ("article", "main"):
            return up
        up = up.parent
    only = [k for k in n.kids if k.tag in ("article", "main") and not k.out and k.own]
    return only[0] if len(only) == 1 else n


def main_text(html: str | None) -> str:
    """The text of the chosen subtree, one space for white space within a block and between blocks."""
    if not html:
        return ""
    root, runs = parse(html)
    if not runs:
        return ""
    node = main_node(root)
    blocks: list[list[str]] = []
    for piece, fresh, own in runs[node.start : node.end]:
        if not own:
            continue
        if fresh or not blocks:
            blocks.append([])
        blocks[-1].append(piece)
    texts = (SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars): one row per page, the whole main text and its code points.

    Null and empty pages, and pages without text, give an empty text; markup that ends early or closes nothing is read
    to its end; rows that repeat stay; null ids and urls stay null; an empty table gives no rows.
    """
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = need(pages, id_col, url_col, html_col).mapInArrow(run, f"id {kind}, url {url_kind}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
