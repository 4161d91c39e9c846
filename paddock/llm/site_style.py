"""Main text of web pages by site style trees.

The element trees of all pages of a host are merged into one style tree: its nodes are paths of
block elements (tag with classes and id, digits masked), its edges the ways they nest.  Every
node gets two importances between 0 and 1, entropies divided by the log of the pages that have
it: presentation (in how many ways the node is laid out, by the sequence of its children) and
content (in how many ways it reads).  Branches whose larger importance is low - the same
words in the same layout on page after page - are removed from each page, unless they carry
much of the host's text.  Elements that say themselves what they are (navigation, footer, form,
script, a whole class, id or role such as ``sidebar`` or ``comments``) have no presentation
importance, whatever they read, but named ones stay if they carry much of the host's text, and no name
counts on html, body, main, article or what lies around the only articles; where a page has an article (or main) element, so has all outside it.

Two scans of the pages: one emits a row per page and style node, which are summed by value and
then by node, so a host of any size is only ever sums; one extracts.  The removed nodes of each
host are joined to its pages: broadcast while Spark finds the table small, else by shuffle.

Text: comments and markup vanish, character references are decoded, white space inside a block
becomes one space, blocks are trimmed and joined by a line feed; a line break ends a block.

Defined results: a null or empty page has an empty text; so has one without text outside removed
branches.  Unclosed elements end with their parent, a stray end tag is ignored, a tag cut off by
the end of the page is markup.  Pages without a host share the tree of the empty host.  Repeated
rows give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.llm import textbytes as tb
from paddock.llm.url_templates import parts
from paddock.scratch import materialise

#: A branch is judged on this many pages at least; below this importance it goes, unless it
#: carries more than this share of the host's characters.
MIN_PAGES, LOW, MUCH_TEXT = 8, 0.2, 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split()
)
APART = frozenset(
    "aside audio button canvas embed fieldset footer form head iframe menu nav noscript object option select svg template textarea video".split()
)
SELF_CLOSING = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
                "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
#: A paragraph also ends where one of these begins.
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A list or table inside keeps the item or cell around it open.
SCOPE = frozenset("ul ol dl table article section div main body html".split())
NAMED_APART = frozenset(
    """ad ads advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie
    cookies copyright dialog discussion disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager
    pagination popup promo promotion promotions recommended related replies reply respond search share sharing sidebar signup skip
    social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements that hold the text are furniture by no name of theirs.
NEVER_APART = frozenset("html body main article".split())
_DIGITS = re.compile(r"\d+")


def _child(path: int, name: str) -> int:
    return xxhash.xxh64_intdigest(name, path & 0xFFFFFFFFFFFFFFFF)


class Element:
    """An open element: style node, and whether it is apart by its tag, inside an article, furniture
    by its name, or around an article."""

    __slots__ = ("tag", "up", "path", "apart", "inside", "named", "around")

    def __init__(self, tag: str, up: "Element | None", path: int, apart: bool = False, inside: bool = False, named: bool = False):
        self.tag, self.up, self.path, self.apart, self.inside, self.named = tag, up, path, apart, inside, named
        self.around = False


class Page:
    """Blocks of a page in order, each with the chain of style nodes around it, or furniture's own node."""

    def __init__(self, source: str):
        self._blocks: list[tuple[str, Element]] = []
        self._nested: list[tuple[Element, str]] = []
        self._words: list[str] = []
        self._open: list[Element] = [Element("", None, 1)]
        self.has_article = False
        self._free = False  # an article lies in no furniture
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[3] is not None:
                tag = m[3].lower()
                if m[2]:
                    self._end(tag)
                else:
                    self._start(tag, m[4])
            elif m[1] and m[1].lower() == "title" and self._open[-1].inside:  # not that of the page
                self._text(m[0].partition(">")[2].rpartition("</")[0])
        self._text(source[at:])
        self._flush()
        self.blocks: list[tuple[str, tuple[int, ...], bool, int | None]] = []  # text, style nodes, inside the article, furniture
        self.children: dict[int, list[str]] = {}
        known: dict[Element, tuple[tuple[int, ...], int | None]] = {}
        for text, e in self._blocks:
            nodes, furniture = self._chain(e, known)
            self.blocks.append((text, nodes, e.inside, furniture))
        for e, name in self._nested:
            if self._chain(e.up, known)[1] is None and not self._furniture(e):
                self.children.setdefault(e.up.path, []).append(name)

    def _furniture(self, e: Element) -> bool:
        """Whether the name counts: not around the article, unless another one lies free."""
        return e.named and (self._free or not e.around)

    def _chain(self, e: Element, known: dict) -> tuple[tuple[int, ...], int | None]:
        """Style nodes from the root to an element, and the outermost furniture among them."""
        below = []
        at: Element | None = e
        while at is not None and at not in known:
            below.append(at)
            at = at.up
        nodes, furniture = known[at] if at is not None else ((), None)
        for one in reversed(below):
            if not nodes or nodes[-1] != one.path:
                nodes = (*nodes, one.path)
            if furniture is None and self._furniture(one):
                furniture = one.path
            known[one] = nodes, furniture
        return nodes, furniture

    def _text(self, raw: str) -> None:
        if not self._open[-1].apart:
            self._words.append(html.unescape(raw))

    def _flush(self) -> None:
        if self._words:
            text = " ".join("".join(self._words).split())
            self._words = []
            if text:
                self._blocks.append((text, self._open[-1]))

    def _pop_to(self, at: int) -> None:
        self._flush()
        del self._open[at:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag == "hr":
            self._flush()
            return
        if tag in VOID:
            return
        closes = SELF_CLOSING.get(tag)
        if tag in ENDS_PARAGRAPH:
            closes = frozenset({"p"})
        if closes:
            for at in range(len(self._open) - 1, 0, -1):
                if self._open[at].tag in closes:
                    self._pop_to(at)
                    break
                if self._open[at].tag in SCOPE:
                    break
        name = tag
        words: list[str] = []
        if attributes:
            held = [(k.lower(), a or b or c) for k, a, b, c in _NAME.findall(attributes)]
            if held:
                words = [w for _, v in held for w in v.lower().split()]
                name += "." + ".".join(_DIGITS.sub("#", v) for _, v in sorted(held))
        up = self._open[-1]
        named = tag not in NEVER_APART and not NAMED_APART.isdisjoint(words)
        if tag in INLINE and not named:
            self._open.append(Element(tag, up, up.path, up.apart, up.inside))
            return
        self._flush()
        apart = up.apart or tag in APART or (tag == "header" and not up.inside)
        here = Element(tag, up, _child(up.path, name), apart, up.inside, named)
        if tag in ("article", "main") and not apart:
            here.inside = self.has_article = True
            self._free = self._free or not any(e.named for e in self._open)
            for e in self._open:
                e.around = True
        if not apart:
            self._nested.append((here, name))
        self._open.append(here)

    def _end(self, tag: str) -> None:
        for at in range(len(self._open) - 1, 0, -1):
            if self._open[at].tag == tag:
                if tag in INLINE and not self._open[at].named:
                    del self._open[at]
                else:
                    self._pop_to(at)
                return

    def kept(self) -> list[tuple[str, tuple[int, ...], int | None]]:
        """Blocks with presentation importance, inside the article, where there is one; furniture's may go."""
        return [(text, nodes, furniture) for text, nodes, inside, furniture in self.blocks if inside or not self.has_article]

    def text(self, removed: frozenset[int]) -> str:
        return "\n".join(text for text, nodes, _ in self.kept() if removed.isdisjoint(nodes))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, value, chars) of each page and style node: kind 0 layout, 1 content, 2 furniture."""
    for part, _, _ in tb.pieces(batches, "html"):
        out: list[tuple[str, int, int, int, int]] = []
        for host, source in zip(tb.column(part, "host").to_pylist(), tb.column(part, "html").to_pylist()):
            page = Page(source or "")
            reads: dict[int, list[str]] = {}
            beside: dict[int, int] = {}
            for text, nodes, furniture in page.kept():
                if furniture is not None:
                    beside[furniture] = beside.get(furniture, 0) + len(text)
                    continue
                for node in nodes:
                    reads.setdefault(node, []).append(text)
            out += [(host, _signed(node), 2, 0, chars) for node, chars in beside.items()]
            for node, texts in reads.items():
                layout = xxhash.xxh64_intdigest(" ".join(page.children.get(node, ())))
                content = xxhash.xxh64_intdigest("\n".join(texts))
                out.append((host, _signed(node), 0, _signed(layout), 0))
                out.append((host, _signed(node), 1, _signed(content), sum(map(len, texts))))
        names = ("host", "node", "kind", "value", "chars")
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content, chars, furniture) of every style node; needs host and html.

    What lies in furniture has characters of its own and counts for no node around it.
    """
    seen = pages.mapInArrow(_nodes, "host string, node bigint, kind int, value bigint, chars bigint")
    values = seen.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))

    def of(kind: int, value):
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0))

    spread = F.col("n") * F.log("n")
    nodes = values.groupBy("host", "node").agg(of(1, F.col("n")).alias("pages"), of(0, spread).alias("s0"), of(1, spread).alias("s1"), of(1, F.col("chars")).alias("chars"), of(2, F.col("chars")).alias("furniture"))
    most = F.log("pages")

    def entropy(s: str):  # (log m - sum(n log n) / m) / log m
        return F.when(F.col("pages") > 1, 1 - F.col(s) / (F.col("pages") * most)).otherwise(F.lit(1.0))

    return nodes.select("host", "node", "pages", entropy("s0").alias("presentation"), entropy("s1").alias("content"), "chars", "furniture")


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, removed): style nodes of low importance; furniture has none, however it reads."""
    # The root's characters are the host's, besides those in furniture.
    whole = tree.groupBy("host").agg(F.max("chars").alias("all"), F.sum("furniture").alias("beside"))
    low = (F.greatest("presentation", "content") < LOW) & (F.col("pages") >= MIN_PAGES) & (F.col("chars") <= MUCH_TEXT * F.col("all"))
    furniture = (F.col("furniture") > 0) & (F.col("furniture") <= MUCH_TEXT * (F.col("all") + F.col("beside")))
    return tree.join(whole, "host").where(low | furniture).groupBy("host").agg(F.collect_set("node").alias("removed"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, _, _ in tb.pieces(batches, "html"):
        removed = [frozenset(x & 0xFFFFFFFFFFFFFFFF for x in r or ()) for r in tb.column(part, "removed").to_pylist()]
        texts = [Page(s or "").text(r) for s, r in zip(tb.column(part, "html").to_pylist(), removed)]
        yield pa.RecordBatch.from_arrays(
            [tb.column(part, "page_id"), tb.column(part, "url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host, _ = parts(pages[url].cast("string"))
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), pages[source].cast("string").alias("html"), host.alias("host"))
    low = materialise(low_branches(style_tree(rows.select("host", "html"))), "style-tree")
    found = rows.join(low, "host", "left").select("page_id", "url", "html", "removed")
    return found.mapInArrow(_extract, "page_id bigint, url string, text string, n_chars bigint")
