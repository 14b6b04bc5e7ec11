"""Main text of pages, with site templates found by counting element subtrees per host.

Every element subtree is hashed, also inside articles, but not an article itself or what holds one; Spark counts on how many
different pages of a host each hash occurs. Subtrees that recur on many of them are template and go. What is left decides where
the main text is: in the articles, else in the main elements, else on the page. Elements that a page itself
marks as furniture go too, unless they hold an article or most of the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetsig.llm.shared import materialise
from fleetsig.llm.urls import host_and_path

SHARE = 0.3
MIN_PAGES = 3

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
_DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea input iframe object embed svg canvas"
    " audio video dialog menu search".split()
)
_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent notice notices"
    " comment comments disqus sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead share sharing social"
    " newsletter subscribe subscription related popup modal".split()
)
# words beside such a mark in one class name; with any other word ("related-work") the name marks nothing
_NEUTRAL = frozenset(
    "area bar block body bottom box button container content form group header holder inner item items left link links list main"
    " outer page panel post right section site slot text title top unit user widget wrap wrapper x"
    .split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_SPARED = frozenset("article blockquote center div fieldset form header main p section span table tbody td tr".split())
_SILENT = frozenset("head script style noscript template svg canvas object embed iframe".split())
# an opening tag ends these elements, if one is open inside the nearest of those
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_SCOPE = ("article", "aside", "blockquote", "body", "dd", "div", "figure", "footer", "form", "header", "li", "main", "nav", "section", "table", "td", "th")
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _furniture(names: str) -> bool:
    """Whether a class name or id says so: all its words are marks or neutral, one at least is a mark."""
    for name in names.lower().split():
        words = _WORDS.findall(name)
        if any(w in _MARKS for w in words) and all(w in _MARKS or w in _NEUTRAL for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "mark", "dropped", "children")

    def __init__(self, tag: str, attrs=()):
        given = {k: (v or "") for k, v in attrs}
        self.tag, self.children = tag, []
        self.mark = f"{tag} {given.get('class', '')} {given.get('id', '')}"
        self.dropped = (
            tag in _DROPPED or _furniture(f"{given.get('class', '')} {given.get('id', '')}") or given.get("role", "").lower() in _ROLES
            or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "").lower()))
        ) and tag not in ("html", "body")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _end(self, tags, scope) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        if tag in _BLOCKS and tag != "br":
            self._end(("p",), _SCOPE)
        if tag == "body":
            self._end(("head",), ())
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "path", "circle", "rect", "g", "use", "polygon"):
            self._end((tag,), ())

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    _spare(builder.root)
    return builder.root


def _walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(x for x in reversed(at.children) if isinstance(x, Node))


def _spare(root: Node) -> None:
    """Take the mark from forms and marked blocks that hold an article, a main element or most of the page's words."""
    order = list(_walk(root))
    words: dict[int, int] = {}
    holds: set[int] = set()
    for node in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node)]
        words[id(node)] = 0 if node.tag in _SILENT else sum(words[id(c)] for c in inside) + sum(
            len(c.split()) for c in node.children if isinstance(c, str)
        )
        if any(id(c) in holds or c.tag in ("article", "main") for c in inside):
            holds.add(id(node))
    for node in order:
        if node.dropped and node.tag in _SPARED and (id(node) in holds or 2 * words[id(node)] > words[id(root)]):
            node.dropped = False


def _holders(root: Node) -> Iterator[list[Node]]:
    """Where the main text may be, best first: the outermost articles, the outermost main elements, the whole page."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            at = stack.pop()
            if at.dropped:
                continue
            if at.tag == wanted:
                found.append(at)
                continue
            stack.extend(x for x in reversed(at.children) if isinstance(x, Node))
        yield found
    yield [root]


def subtree_hashes(root: Node) -> dict[int, int]:
    """Hash of every element subtree with text, by the node's identity; articles and what holds one have none."""
    found, without = {}, set()
    for node in reversed(list(_walk(root))):  # children before parents
        parts, text = [node.mark], False
        if node.tag in ("article", "main", "body"):
            without.add(id(node))
        for child in node.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                if words:
                    parts.append(words)
                    text = True
            elif id(child) in without:
                without.add(id(node))
            elif id(child) in found:
                parts.append(found[id(child)])
                text = True
        if text and id(node) not in without:
            found[id(node)] = xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "replace")) - (1 << 63)
    return found


def _text(node: Node, templates: frozenset, hashes: dict[int, int]) -> str:
    """Blocks of a subtree in page order, without dropped elements and templates."""
    blocks, line, stack = [], [], [iter([node])]
    ends = [False]

    def flush():
        words = "".join(line).split()
        if words:
            blocks.append(" ".join(words))
        line.clear()

    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                flush()
        elif isinstance(child, str):
            line.append(child)
        elif not child.dropped and hashes.get(id(child)) not in templates:
            block = child.tag in _BLOCKS
            if block:
                flush()
            stack.append(iter(child.children))
            ends.append(block)
    flush()
    return " ".join(blocks)


def main_text(html: str | None, templates=frozenset()) -> str:
    root = parse(html)
    hashes = subtree_hashes(root) if templates else {}
    for holders in _holders(root):
        texts = [_text(node, templates, hashes) for node in holders]
        if any(texts):
            return " ".join(filter(None, texts))
    return ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page content, subtree), and subtree 0 for the page as such."""
    for part in batches:
        hosts, pages, trees = [], [], []
        for host, html in zip(part.column(0).to_pylist(), part.column(1)):
            html = html.as_py() or ""
            root = parse(html)
            own = {0, *subtree_hashes(root).values()}
            hosts.extend([host] * len(own))
            pages.extend([xxhash.xxh64_intdigest(html.encode("utf-8", "replace")) - (1 << 63)] * len(own))
            trees.extend(own)
        columns = [pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(trees, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "page", "tree"])


def templates(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, trees)``: hashes of subtrees on at least ``min_pages`` and ``share`` of a host's different pages.

    Copies of a page count once. A page has so many subtrees, so at most ``1 / share`` times as many recur on a host.
    """
    host = host_and_path(F.col(url))[0]
    seen = pages.select(host.alias("host"), F.col(html).alias("html")).mapInArrow(_count, "host string, page long, tree long")
    counts = seen.distinct().groupBy("host", "tree").agg(F.count("*").alias("n"))
    counts = materialise(counts.where(F.col("n") >= min_pages), "subtrees")
    whole = counts.where("tree = 0").select("host", F.col("n").alias("of"))
    often = counts.where("tree <> 0").join(whole, "host").where(F.col("n") >= share * F.col("of"))
    return often.groupBy("host").agg(F.collect_list("tree").alias("trees"))


def extract(
    pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``(page, url, text, n_chars)`` per row of ``pages``: the article's blocks joined by one space, "" if there is none.

    Templates of the page's host and elements marked as furniture go first, inside articles too; then the text is that of all
    ``article`` elements in page order, of the ``main`` elements where they leave none, else of the whole page. Nothing is
    cut off; null html is empty; null urls share one host; repeated pages and ids are kept, and copies of a page
    count once, so they make no template.
    """
    site = templates(pages, share, min_pages, url, html)
    named = pages.select(
        F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), host_and_path(F.col(url))[0].alias("host")
    )
    kind = named.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = [
                main_text(page.as_py(), frozenset(trees.as_py() or ())) for page, trees in zip(part.column(2), part.column(3))
            ]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page", "url", "text", "n_chars"])

    met = named.join(materialise(site, "templates"), "host", "left").select("page", "url", "html", "trees")
    return met.mapInArrow(run, f"page {kind}, url string, text string, n_chars long")
