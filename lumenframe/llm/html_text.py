"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, which are discounted by
link density. The best container, widened to the article or main element around it, is kept
with those siblings that read like text; what is left of menus, adverts, forms, comments and
the like inside it is cut out first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.columns import packed, unpacked

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of BLOCK ends an open paragraph; these also end an open element of their own kind.
SELF_ENDING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article main section div".split())
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas dialog menu audio video title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies "
    "copyright disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
HEADER_NAMES = frozenset(("header",))
WRAPPERS = frozenset("header masthead menu modal nav overlay share sidebar skip social".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ROOTS = frozenset(("article", "main"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_MODIFIER = re.compile(r"(has|with|no|without|is|layout|js|theme)[-_]")
_TAG = re.compile(r"<[a-zA-Z/!?]")
_COMMENT_END = re.compile("--!?>")
#: Names of reader comments, which may be article elements themselves.
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())


class Node:
    """An element; children are nodes and strings in page order."""

    __slots__ = ("children", "commas", "headings_only", "length", "linked", "named", "order", "parent", "score", "tag", "wrapper")

    def __init__(self, tag: str, parent: Node | None, order: int) -> None:
        self.tag, self.parent, self.order, self.children = tag, parent, order, []
        self.score, self.length, self.linked, self.commas, self.headings_only = 0.0, 0, 0, 0, False
        self.named = False  # named like noise
        self.wrapper = False  # by a name that the elements round an article have too; it stays if an article turns out to stand in it


def _words(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words of the class and id names, without names that only say what a layout has or lacks."""
    names = [n for name, value in attrs if name in ("class", "id") for n in (value or "").lower().split() if not _MODIFIER.match(n)]
    return set(_WORD.findall(" ".join(names)))


def _noise(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element is no part of an article whatever it holds; inside: it stands in an article or main element."""
    if tag in DROPPED:
        return True
    if tag in ("body", "html"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
    return tag == "header" and not inside


class _Tree(HTMLParser):
    """A forgiving tree builder; subtrees that are no part of an article are read past.

    Open elements are counted by tag, so that a tag that ends none of them costs no walk.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None, 0)
        self.open: list[tuple[Node, bool]] = [(self.root, False)]  # with whether it is dropped
        self.nodes = [self.root]
        self.count: Counter = Counter()
        self.rooted = 0
        self.cleared = 1  # open elements that an article has looked at

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            node, dropped = self.open.pop()
            self.count[node.tag] -= 1
            self.rooted -= node.tag in ROOTS and not dropped

    def _end(self, tags: tuple[str, ...], within: frozenset[str]) -> None:
        if not any(self.count[t] for t in tags):
            return None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i][0].tag
            if tag in tags:
                return self._pop(i)
            if tag in within:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK:
            self._end(("p",), SCOPE)
        if tag in SELF_ENDING:
            self._end(SELF_ENDING[tag], frozenset(SCOPE - {"div", "section"}))
        parent, dropped = self.open[-1]
        dropped = dropped or _noise(tag, attrs, self.rooted > 0)
        node = Node(tag, parent, len(self.nodes))
        if attrs and not dropped:
            words = _words(attrs)
            node.named = bool(words & (COMMENTS if tag in ROOTS else NAMES)) or (self.rooted == 0 and bool(words & HEADER_NAMES) and tag not in ROOTS)
            node.wrapper = words & (NAMES | HEADER_NAMES) <= WRAPPERS
        if not dropped:
            if tag in ROOTS and not node.named:
                self.cleared = min(self.cleared, len(self.open))
                for above, _ in self.open[self.cleared :]:
                    above.named = above.named and not above.wrapper
                self.cleared = len(self.open)
            node.headings_only = parent.headings_only or tag == "header"
            parent.children.append(node)
            self.nodes.append(node)
        if tag not in VOID:
            self.open.append((node, dropped))
            self.count[tag] += 1
            self.rooted += tag in ROOTS and not dropped

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def read(self, html: str) -> None:
        """The whole page. A tag that never ends is dropped, as is what follows it, instead of being tried from every sign on."""
        whole = html.rfind(">") + 1
        self.feed(html[:whole])
        self.feed(_TAG.split(html[whole:], maxsplit=1)[0])
        self.close()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, 0)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = _COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def handle_endtag(self, tag: str) -> None:
        if not self.count[tag]:
            return None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0].tag == tag:
                return self._pop(i)
        return None

    def handle_data(self, data: str) -> None:
        node, dropped = self.open[-1]
        if not dropped:
            node.children.append(data)


def _pruned(nodes: list[Node]) -> list[Node]:
    """The nodes that are not named like noise, nor stand in one that is; they leave their parents too."""
    kept = []
    for node in nodes:  # parents come first
        if node.parent is not None and node.parent.named:
            node.named = True
        if not node.named:
            kept.append(node)
    for node in kept:
        if any(isinstance(c, Node) and c.named for c in node.children):
            node.children = [c for c in node.children if not (isinstance(c, Node) and c.named)]
    return kept


def _score(nodes: list[Node]) -> None:
    """Lengths, links and commas from the leaves up, then the points of paragraphs to their ancestors."""
    for node in reversed(nodes):
        own = [" ".join(c.split()) for c in node.children if isinstance(c, str)]
        node.length += sum(map(len, own))
        node.commas += sum(x.count(",") + x.count("،") + x.count("，") for x in own)
        if node.tag == "a":
            node.linked = node.length
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    for node in nodes:
        direct = node.tag in ("p", "pre", "blockquote", "td") or (node.tag in ("div", "section", "article", "main") and any(isinstance(c, str) and c.strip() for c in node.children))
        if not direct or not node.length:
            continue
        points = (node.length >= 25) + node.commas + min(node.length / 100, 3.0)
        share, above = 1.0, node.parent if node.tag in ("p", "pre", "blockquote", "td") else node
        for level in range(5):
            if above is None:
                break
            above.score += points * share
            share = 1 / 2 if level == 0 else 1 / (3 * (level + 1))
            above = above.parent


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def main_text(html: str | None) -> str:
    """Text of the article of a page: its blocks in page order, one a line; empty if there is none.

    A null page is empty. White space inside a block is one space; blocks without text go.
    """
    if not html:
        return ""
    tree = _Tree()
    tree.read(html)
    nodes = _pruned(tree.nodes)
    _score(nodes)
    best = max(nodes, key=lambda n: (n.score * (1 - _density(n)), -n.order))
    around, up = best, best
    while up is not None:
        if up.tag in ROOTS:
            around = up
        up = up.parent
    kept = [around]
    if around.parent is not None and around.tag not in ROOTS:
        least = max(10.0, 0.2 * best.score)
        kept = [
            n
            for n in around.parent.children
            if isinstance(n, Node)
            and (
                n is around
                or n.score * (1 - _density(n)) >= least
                or (n.tag in HEADINGS and _density(n) < 0.25)
                or (n.tag == "p" and n.length and (_density(n) < 0.25 if n.length > 80 else not n.linked))
            )
        ]
    elif around.tag in ROOTS and around.parent is not None:
        kept = [n for n in around.parent.children if isinstance(n, Node) and (n is around or (n.tag in ROOTS and n.score * (1 - _density(n)) >= max(10.0, 0.2 * around.score)))]
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    todo: list[Node | str | None] = list(reversed(kept))
    headed = 0
    while todo:
        item = todo.pop()
        if item is None:  # the end of a block
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif isinstance(item, int):
            headed -= 1
        elif item.tag == "br":
            run.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            heading = item.tag in HEADINGS
            if item.headings_only and heading:
                headed += 1
                todo.append(0)
            keep_text = not item.headings_only or headed
            todo.extend(c for c in reversed(item.children) if keep_text or isinstance(c, Node))
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text, the main text of html; a column named text is replaced."""

    @F.pandas_udf("string")
    def text(html: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in html:
            yield series.map(main_text, na_action=None)

    return unpacked(packed(pages, "html"), pages.columns, text=text("html"))


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page and its number of code points."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text").withColumn("n_chars", F.char_length("text").cast("long"))
