"""Main text of web pages by scoring the element tree.

A page becomes a tree of elements; text goes to blocks. Every block of some length passes points (one, one for
each comma, up to three for its length) to its parent, half to the grandparent and less to the next ones.
A container's points are discounted by the part of its text that is links. The best container, widened to the article or main
element around it, is kept with those of its siblings that look like text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.common import raw

# fixed values: element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    (
        "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
        "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
        "search section summary table tbody td tfoot th thead tr ul"
    ).split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split())
#: A start tag ends an open element of its own kind, up to the element that holds the kind.
ITEM = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td th li dd dt blockquote figcaption address caption summary".split()) | HEADING
LIST = frozenset("ul ol menu dl table".split())

#: Never part of an article.
DROP = frozenset(
    "nav aside footer form button select datalist svg canvas object audio video dialog menu search head math".split()
)
ROLE = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
#: Parts of class and id names that mark what is not the article.
MARK = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
        "navigation menu menubar breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar comment comments "
        "commentlist respond replies disqus cookie cookies notice notices consent gdpr alert popup modal overlay share "
        "sharing social related recommended newsletter subscribe subscription signup login search pagination pager "
        "widget rail skip toc"
    ).split()
)
#: In one name with a mark they say that the element holds more than that.
MORE = frozenset("with has no without content".split())
KEEP = frozenset("html body article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]*)))?", re.I
)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}


def _marked(names: str) -> bool:
    for name in names.split():
        parts = {p.lower() for p in _NAME.findall(name)}
        if parts & MARK and not parts & MORE:
            return True
    return False


class Page:
    """The tree of one page: parallel lists of elements in page order, and blocks of text."""

    def __init__(self, html: str, by_name: bool = True):
        self.by_name = by_name
        self.tag, self.parent, self.drop = ["#root"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._stack = [0]
        self._block = [0]  # of each element on the stack: the nearest block
        self._count: Counter[str] = Counter()  # open elements of each tag
        self._links = 0
        self._text: list[str] = []
        self._linked = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self._say(html[at:])
                break
            if m.start() > at:
                self._say(html[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                self._say(m[0][9:].removesuffix("]]>"))
                continue
            end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._close(tag)
                continue
            self._open(tag, rest or "")
            if tag in RAW:
                stop = _END[tag].search(html, at)
                at = stop.end() if stop else n
        self._flush()

    def _say(self, text: str) -> None:
        if self.drop[self._stack[-1]]:
            return
        text = unescape(text) if "&" in text else text
        self._text.append(text)
        if self._links:
            self._linked += len("".join(text.split()))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._block[-1], text, self._linked))
            self._text, self._linked = [], 0

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag = self.tag[self._stack.pop()]
            self._block.pop()
            self._count[tag] -= 1
            self._links -= tag == "a"

    def _open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._say(" ")
            return
        if tag in BLOCK:
            self._flush()
        if tag in RAW or tag in VOID:
            return
        if tag in CLOSES_P:
            self._end("p", frozenset(("button", "td", "th", "caption", "table")))
        if tag in ITEM:
            kinds, holders = ITEM[tag]
            for kind in kinds:
                self._end(kind, holders)
        if tag == "a" and self._links:
            self._end("a", BLOCK)
        up = self._stack[-1]
        unwanted = self.drop[up] or self._unwanted(tag, rest)
        self._stack.append(len(self.tag))
        self._block.append(self._stack[-1] if tag in BLOCK else self._block[-1])
        self._count[tag] += 1
        self.tag.append(tag)
        self.parent.append(up)
        self.drop.append(unwanted)
        self._links += tag == "a"

    def _end(self, tag: str, limit: frozenset | set) -> None:
        """Close the innermost ``tag`` that is open inside the innermost element of ``limit``."""
        if not self._count[tag]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            kind = self.tag[self._stack[depth]]
            if kind == tag:
                self._pop_to(depth)
                return
            if kind in limit:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if tag in ("br", "p") and not self._count[tag]:
            self._say(" ")
            return
        self._end(tag, frozenset(("table",)) if tag not in BLOCK or tag == "p" else frozenset())

    def _unwanted(self, tag: str, rest: str) -> bool:
        if tag in DROP:
            return True
        inside = tag == "header" and self._count["article"] > 0
        if tag == "header" and not inside:
            return True
        if not rest.strip() or tag in KEEP:
            return False
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True
            if name == "style" and _HIDDEN.search(value) or name == "role" and value.lower() in ROLE:
                return True
            if name in ("class", "id") and self.by_name and not inside and _marked(value):
                if tag in HEADING and self._count["article"]:
                    continue
                return True
        return False

    def main_text(self) -> str:
        n = len(self.tag)
        size, links, points = [0] * n, [0] * n, [0.0] * n
        for node, text, linked in self.blocks:
            long = len(text)
            size[node] += long
            links[node] += linked
            if long < 25 and self.tag[node] not in ("p", "pre"):
                continue
            given = (1 + text.count(",") + text.count("，") + min(long / 100, 3)) * (1 - min(1.0, linked / long))
            up = self.parent[node] if self.tag[node] in PARAGRAPH else node
            for level in range(6):
                if up < 1:
                    break
                points[up] += given / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up = self.parent[up]
        for node in range(n - 1, 0, -1):
            size[self.parent[node]] += size[node]
            links[self.parent[node]] += links[node]
        final = [p * (1 - min(1.0, k / s)) if s else 0.0 for p, k, s in zip(points, links, size)]
        best = max(range(n), key=lambda i: (final[i], -i)) if n else 0
        if final[best] <= 0:
            best = next((i for i in range(n) if self.tag[i] in ("article", "main", "body")), 0)
        around, up = best, best
        while up > 0:
            if self.tag[up] in ("article", "main"):
                around = up
                break
            up = self.parent[up]
        keep = [False] * n
        keep[around] = True
        for node in range(1, n):
            if self.parent[node] == self.parent[around] and node != around and around:
                dense = links[node] / size[node] if size[node] else 1.0
                if (
                    self.tag[node] in HEADING and node < around and dense < 0.5
                    or final[node] >= max(10.0, 0.2 * final[best])
                    or self.tag[node] in ("p", "pre", "blockquote", "section", "div", "figure")
                    and (size[node] >= 80 and dense < 0.25 or size[node] > 0 and not links[node] and self.tag[node] == "p")
                ):
                    keep[node] = True
        counted = [0] * n
        for node in range(1, n):
            keep[node] = keep[node] or keep[self.parent[node]]
            if self.tag[node] == "a":
                up = self.parent[node]
                for _ in range(4):
                    if up < 1:
                        break
                    if self.tag[up] in LIST:
                        counted[up] += 1
                        break
                    up = self.parent[up]
        for node in range(1, n):  # a list of links is a menu
            if self.tag[node] in LIST and counted[node] >= 3 and size[node] and links[node] >= 0.8 * size[node]:
                keep[node] = False
            elif not keep[self.parent[node]] and keep[node] and node != around and self.parent[node] != self.parent[around]:
                keep[node] = False
        return "\n\n".join(text for node, text, _ in self.blocks if keep[node])


def main_text(html: str | None) -> str:
    """Blocks of the article joined by blank lines; without one, of what is left of the page."""
    if not html:
        return ""
    return Page(html).main_text() or Page(html, by_name=False).main_text()


def main_text_column(html: str | Column) -> Column:
    """Main text of a column of pages; null pages have the empty text."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.decode("utf-8", "replace")) if p else "" for p in pages.to_pylist()], pa.string())

    return run(raw(html))


def extract_pages(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars of every page; null and empty pages have the empty text, repeated rows stay."""
    text = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), main_text_column(html).alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
