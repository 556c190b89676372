"""Main text of web pages by composite text density.

A page becomes a tree, read in one pass: open elements are kept by name, so the time is in proportion to the page however deep it nests. Elements that hold no
article text by their tag (menus, footers, asides, forms, ...) or their label (class, id or role: adverts, notices, comments, ...) go first; a label other than of
comments is only evidence, and doesn't take away an element with more than half of the page's text outside links. Every remaining node gets its text density: characters per tag,
lowered by the share of link characters and link tags. The density sum of a node adds the densities of its children; the node with the largest
sum is where the text is, and the container around it (an article, section, division, table cell or the body) is its region. Where one container in it holds nine tenths
of its text outside links, that one is the region. The least density on the way from it to the root is the threshold: wherever, on the way up, a neighbour of the region reaches it and is not mostly links, the text extends from the first to the last
of them; headings before the region belong to it if it has none itself. What remains outside goes.

Text is read block by block in page order: character references decoded, white space within a block made one space, blocks joined by
a newline, nothing else dropped or capped.

Defined results: a null or empty page, or one without text, gives an empty text; broken markup is read as far as it goes (unclosed
elements end with their parent, stray end tags are ignored, an unclosed comment or script runs to the end, a quote that never closes is none, what follows
a last unclosed tag is text); equal pages have equal texts; of nodes with equal sums the first is taken; repeated rows are kept; an empty table gives an empty
result; added columns replace clashing ones. A page of any length is read in one piece, in about 1 kB of memory a tag.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import map_texts, table

TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?]")
QUOTE = re.compile(r"""=\s*(["'])""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
# Elements by their part in a page.
RAW = frozenset("script style textarea title noscript iframe template svg math xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption html option tbody td tfoot th thead tr".split())
NOT_TEXT = frozenset("nav footer aside form button select input menu dialog object applet head datalist".split())
CONTAINER = frozenset("article main section div body html td table tbody tr center details".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|sidebar|side-bar|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|footer|masthead|site-header|page-header"
    r"|cookie|cookies|consent|notice|notices|popup|modal|overlay|subscribe|subscription|newsletter|signup|login|share|sharing|social|related|recommended|pagination|pager|widget|toolbar|copyright|disclaimer)(?=$|[\s_-])"
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|reply|replies|disqus|respond)(?=$|[\s_-])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())


KEPT, LABELLED, GONE = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "inside", "scope", "chars", "links", "tags", "link_tags", "heads", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: int):
        self.tag, self.parent, self.items, self.drop = tag, parent, [], drop
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.scope = scope_of(self, parent.scope if parent else {})


def scope_of(node: Node, outer: dict) -> dict:
    """The open element that each kind of start tag would end, as seen from inside the node."""
    scope, tag = outer, node.tag
    if tag in CONTAINER and "p" in scope or tag == "p":
        scope = scope | {"p": node if tag == "p" else None}
    for kind, (ended, stops) in CLOSES.items():
        if tag in stops and scope.get(kind) is not None:
            scope = scope | {kind: None}
        elif tag in ended.split():
            scope = scope | {kind: node}
    return scope


def label(tag: str, attributes: str, inside_article: bool) -> int:
    """What an element's tag and attributes say of it."""
    if tag in NOT_TEXT or tag == "header" and not inside_article:
        return GONE
    if tag in ("body", "html", "article", "main") or not attributes:
        return KEPT
    found = KEPT
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and COMMENTS.search(value) or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return GONE
        if name in ("class", "id") and BOILER.search(value) or name == "role" and value in ROLES:
            found = LABELLED
    return found


def tags(page: str):
    """(start, end, closing, name, attributes) of the tags, name None for comments and declarations; time is in proportion to the page."""
    at, unclosed = 0, set()
    while (m := TAG.search(page, at)) is not None:
        name = m[2] and m[2].lower()
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            yield m.start(), at, False, None, ""
            continue
        end = page.find(">", m.end())
        look = m.end()
        while name and not m[1] and end >= 0 and (q := QUOTE.search(page, look, end)) is not None:
            shut = -1 if q[1] in unclosed else page.find(q[1], q.end())
            if shut < 0:
                unclosed.add(q[1])
                break
            look = shut + 1
            if look > end:
                end = page.find(">", look)
        if end < 0:
            if name:
                return
            end = len(page) - 1
        at = end + 1
        attributes = page[m.end() : end]
        if name in RAW and not m[1]:
            shut = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else len(page)
            name = None
        yield m.start(), at, bool(m[1]), name, attributes


def parse(page: str) -> Node:
    root = Node("html", None, KEPT)
    path, open_by_tag, at = [root], {}, 0

    def close(x: Node) -> None:
        while path[-1] is not x:
            open_by_tag[path.pop().tag].pop()
        open_by_tag[path.pop().tag].pop()

    for start, end, closing, tag, attributes in tags(page):
        if start > at:
            path[-1].items.append(page[at:start])
        at = end
        if tag is None:
            continue
        if closing:
            if open_by_tag.get(tag):
                close(open_by_tag[tag][-1])
            elif tag == "br":
                path[-1].items.append(" ")
            continue
        if tag in ("html", "body") and len(path) == 1:
            root.tag = tag
            continue
        if tag == "br":
            path[-1].items.append(" ")
            continue
        if tag in ENDS_P and (p := path[-1].scope.get("p")) is not None:
            close(p)
        if tag in CLOSES and (x := path[-1].scope.get(tag)) is not None:
            close(x)
        node = path[-1]
        child = Node(tag, node, max(node.drop, label(tag, attributes, node.inside or node.tag in ("article", "main"))) if node.drop != LABELLED else max(KEPT, label(tag, attributes, True)))
        node.items.append(child)
        if tag not in VOID:
            path.append(child)
            open_by_tag.setdefault(tag, []).append(child)
    if at < len(page):
        path[-1].items.append(page[at:])
    return root


def counted(order: list[Node]) -> None:
    """Characters, those of links and headings, tags and link tags of the nodes, children after parents in the list."""
    for x in reversed(order):
        x.chars = x.links = x.tags = x.link_tags = x.heads = 0
        for i in x.items:
            if isinstance(i, str):
                x.chars += len(i.strip())
            else:
                x.chars += i.chars
                x.links += i.links
                x.heads += i.heads
                x.tags += i.tags + 1
                x.link_tags += i.link_tags + (i.tag == "a")
        if x.tag == "a":
            x.links, x.link_tags = x.chars, x.tags
        if x.tag in ("h1", "h2"):
            x.heads = x.chars


def without(root: Node, gone) -> list[Node]:
    """The nodes that stay when those of which ``gone`` says so have left the tree, parents before children, in page order."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        x.items = [i for i in x.items if isinstance(i, str) or not gone(i)]
        stack.extend(i for i in reversed(x.items) if not isinstance(i, str))
    return order


def measure(root: Node) -> list[Node]:
    """Counts and densities of the nodes that stay."""
    counted(without(root, lambda x: x.drop == GONE))
    most = (root.chars - root.links) / 2
    order = without(root, lambda x: x.drop == LABELLED and x.chars - x.links <= most)
    counted(order)
    whole = root.links / max(root.chars, 1)
    for x in reversed(order):
        base = math.log(x.chars / max(x.chars - x.links, 1) * x.links + whole * x.chars + math.e)
        ratio = x.chars / max(x.links, 1) * max(x.tags, 1) / max(x.link_tags, 1)
        x.density = x.chars / max(x.tags, 1) * max(math.log(ratio) / base, 0.0) if x.chars else 0.0
        x.total = sum(i.density for i in x.items if not isinstance(i, str))
        if not x.total:
            x.total = x.density * 1e-9
    return order


def choose(root: Node) -> Node:
    """Leaves the text in the tree: the region of the node with the largest density sum, and what belongs to it on the way up."""
    region = max(measure(root), key=lambda x: x.total)
    while region is not root and region.tag not in CONTAINER:
        region = region.parent
    while (inner := next((y for y in region.items if not isinstance(y, str) and y.tag in CONTAINER and (y.chars - y.links) * 10 >= (region.chars - region.links) * 9 > 0), None)) is not None:
        region = inner
    path = [region]
    while path[-1] is not root:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    has_head = region.heads > 0
    for below, x in zip(path, path[1:]):
        place = next(i for i, y in enumerate(x.items) if y is below)
        own = [i for i, y in enumerate(x.items) if not isinstance(y, str) and y.chars and y is not below and y.density >= threshold and y.links * 2 < y.chars]
        heads = [] if has_head else [i for i, y in enumerate(x.items[:place]) if not isinstance(y, str) and y.heads * 2 > y.chars and y.links * 2 < y.chars]
        has_head = has_head or bool(heads)
        first, last = min([place, *own, *heads]), max([place, *own])
        x.items = [y for y in x.items[first : last + 1] if isinstance(y, str) or y is below or y.links * 2 < y.chars]
    return root


def article_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, line = [], []

    def end():
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    stack: list = [choose(parse(page))]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x is None:
            end()
        else:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack.extend(reversed(x.items))
    end()
    return "\n".join(blocks)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages -> also text and n_chars, in place of the column."""
    source = pages.select(*[c for c in pages.columns if c.lower() not in ("text", "n_chars", column)], F.col(column).alias("text"))

    def make():
        def work(rows):
            texts = [article_text(x) for x in rows]
            return [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]

        return work

    return map_texts(source, make, "text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
