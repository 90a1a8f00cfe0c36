"""Main text of web pages by tree scoring.

A page is read into a tree. Parts that are never article text (menus, forms, scripts,
adverts, notices, comments and the like, by element, role or class) are cut off. Each
paragraph passes points for its length and commas to its ancestors: all of them to its
parent, half to the next, a third of that further up. A container's points are
discounted by its link density. The best container is kept with those of its siblings
that score near it; an article or main element around it stands for it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by role, and words that name page furniture.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template head nav footer aside menu dialog button select option datalist"
    " object svg canvas video audio map input label fieldset legend".split()
)
BLOCKS = frozenset(
    "html body address article blockquote caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup hr li"
    " main ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open elements, if no boundary stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCKS - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr"} | {"nav", "footer", "aside"}
#: An end tag does not reach out of these, unless it is one of the others.
CELLS, CROSSES_CELLS = ("td", "th", "table"), frozenset("tr tbody table div article body html".split())
P_BOUNDARY = frozenset("td th caption table button object".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner sidebar side menu nav navbar"
    " navigation breadcrumb breadcrumbs footer footnotes foot header masthead topbar toolbar comment comments disqus respond reply replies cookie cookies"
    " consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search related recommended recommendations"
    " share sharing social pagination pager copyright skip disclaimer".split()
)
MODIFIERS = frozenset("has with without no not is".split())
CONTENT = frozenset("content article main post entry story body text prose".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """An element: its name, parent, children (elements and texts), and words of its class and id."""

    __slots__ = ("name", "parent", "children", "attributes", "score")

    def __init__(self, name: str, parent: Node | None, attributes: str = "") -> None:
        self.name, self.parent, self.children, self.attributes, self.score = name, parent, [], attributes, 0.0


class _Path:
    """The open elements, and by name at which depths they stand; a step takes no time in proportion to the depth."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        """End all elements from this depth on."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().name].pop()

    def last(self, names) -> int:
        """Depth of the innermost element of these names, 0 without one."""
        return max((self.depths[x][-1] for x in names if self.depths.get(x)), default=0)

    def first_after(self, names, depth: int) -> int:
        """Depth of the outermost element of these names that stands deeper, 0 without one."""
        found = []
        for x in names:
            at = self.depths.get(x, ())
            if (nth := bisect_right(at, depth)) < len(at):
                found.append(at[nth])
        return min(found, default=0)


def parse(page: str) -> Node:
    """The tree of a page; unclosed, misnested and cut-off markup is mended as browsers do, in one pass."""
    path = _Path(Node("#root", None))
    root, at = path.nodes[0], 0
    while found := _TOKEN.search(page, at):
        if found.start() > at:
            path.nodes[-1].children.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            depth = path.last((name,))
            if depth and (name in CROSSES_CELLS or depth >= path.last(CELLS)):
                path.cut(depth)
            continue
        ended, stops = ENDS.get(name, (None, None))
        if ended and (depth := path.first_after(ended, path.last(stops))):
            path.cut(depth)
        if name in CLOSES_P and (depth := path.last(("p",))) > path.last(P_BOUNDARY):
            path.cut(depth)
        child = Node(name, path.nodes[-1], found[3])
        path.nodes[-1].children.append(child)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not (found[3].endswith("/") and name not in BLOCKS):
            path.push(child)
    if at < len(page):
        path.nodes[-1].children.append(page[at:])
    return root


def _is_furniture(node: Node, in_article: bool, paragraphs: int) -> bool:
    if node.name in DROPPED:
        return True
    if node.name == "header" and not in_article:
        return True
    if node.name == "form" and paragraphs < 3:
        return True
    if not node.attributes or node.name in ("html", "body", "main", "article"):
        return False
    values = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(node.attributes)}
    if "hidden" in values or values.get("aria-hidden") == "true" or values.get("role", "").lower() in ROLES or "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    names = values.get("class", "")
    if node.name not in HEADINGS | {"p", "span", "a", "b", "i", "em", "strong"}:
        names += " " + values.get("id", "")
    return any(_names_furniture([w.lower() for w in _WORD.findall(name)]) for name in names.split())


def _names_furniture(words: list[str]) -> bool:
    """Whether a class or id names furniture: ``post-comments`` and ``comment-text`` do, ``has-sidebar`` and ``entry-header`` do not."""
    if not words or MODIFIERS & set(words) or not FURNITURE & set(words):
        return False
    if words[-1] == "header" and words[0] in CONTENT:
        return False
    return words[0] in FURNITURE or words[-1] not in CONTENT


def _prune(root: Node) -> list[Node]:
    """Cut furniture off; all elements left, parents before children."""
    paragraphs: dict[int, int] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in reversed(order):
        own = paragraphs.get(id(node), 0) + (node.name == "p")
        if node.parent is not None:
            paragraphs[id(node.parent)] = paragraphs.get(id(node.parent), 0) + own
    left, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        left.append(node)
        inside = inside or node.name in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _is_furniture(c, inside, paragraphs.get(id(c), 0))]
        todo.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))
    return left


def _lengths(nodes: list[Node]) -> tuple[dict[int, int], dict[int, int], dict[int, tuple[int, int]]]:
    """Characters of text, and of text in links, below each element; and its characters with white space, and commas."""
    whole: dict[int, tuple[int, int]] = {}
    text: dict[int, int] = {}
    linked: dict[int, int] = {}
    for node in reversed(nodes):
        own = text.get(id(node), 0) + sum(len(c.strip()) for c in node.children if isinstance(c, str))
        text[id(node)] = own
        size, commas = whole.get(id(node), (0, 0))
        for c in node.children:
            if isinstance(c, str):
                size, commas = size + len(c), commas + c.count(",")
        whole[id(node)] = size, commas
        inside = own if node.name == "a" else linked.get(id(node), 0)
        linked[id(node)] = inside
        if node.parent is not None:
            text[id(node.parent)] = text.get(id(node.parent), 0) + own
            linked[id(node.parent)] = linked.get(id(node.parent), 0) + inside
            above = whole.get(id(node.parent), (0, 0))
            whole[id(node.parent)] = above[0] + size, above[1] + commas
    return text, linked, whole


def _pass_up(nodes: list[Node], points: dict[int, float]) -> None:
    """All points of an element to itself, half to its parent, and to each further ancestor a third of what the one below it got."""
    near: dict[int, float] = {}
    far: dict[int, float] = {}
    for node in reversed(nodes):
        own, half, rest = points.get(id(node), 0.0), near.get(id(node), 0.0), far.get(id(node), 0.0)
        node.score = own + half + rest
        if node.parent is not None:
            near[id(node.parent)] = near.get(id(node.parent), 0.0) + own / 2
            far[id(node.parent)] = far.get(id(node.parent), 0.0) + (half + rest) / 3


def _chosen(nodes: list[Node]) -> list[Node]:
    """The best container and the siblings kept with it."""
    text, linked, whole = _lengths(nodes)
    points: dict[int, float] = {}
    for node in nodes:
        direct = "".join(c for c in node.children if isinstance(c, str)).strip() if node.name not in ("#root", "html", "body") else ""
        holds = bool(direct) and node.name in ("div", "section", "article", "main", "center")
        if not (holds or node.name in ("p", "pre", "blockquote", "li", "td", "dd")) or not text[id(node)] or node.parent is None:
            continue
        size, commas = whole[id(node)] if node.name in ("p", "pre") else (len(direct), direct.count(","))
        holder = node if holds else node.parent
        points[id(holder)] = points.get(id(holder), 0.0) + 1 + commas + min(size / 100, 3)
    _pass_up(nodes, points)
    best, most = None, 0.0
    for node in nodes:
        node.score *= 1 - linked[id(node)] / max(text[id(node)], 1)
        if node.score > most and node.name not in ("#root", "html"):
            best, most = node, node.score
    if best is None:
        marked = [n for n in nodes if n.name in ("article", "main") and text[id(n)]]
        return [max(marked, key=lambda n: text[id(n)])] if marked else [n for n in nodes if n.name == "body"][:1] or nodes[:1]
    around = best
    while around.parent is not None:
        if around.name in ("article", "main"):
            best = around
        around = around.parent
    if best.name == "body" or best.parent is None:
        return [best]
    kept = []
    for other in best.parent.children:
        if other is best:
            kept.append(other)
        elif isinstance(other, Node) and best.name != "main":
            density = linked[id(other)] / max(text[id(other)], 1)
            near = other.score >= max(0.2 * best.score, 4) or (other.name in ("h1", "h2") and density < 0.5) or (other.name == "p" and text[id(other)] > 80 and density < 0.25)
            if near:
                kept.append(other)
    return kept


def _blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order, references decoded, white space folded, none empty."""
    out: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if block := " ".join(html.unescape("".join(parts)).split()):
            out.append(block)
        parts.clear()

    for top in nodes:
        close()
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                parts.append(x)
            elif x.name in BLOCKS:
                close()
                stack.append(None)
                stack.extend(reversed(x.children))
            elif x.name in ("br", "td", "th"):
                parts.append(" ")
                stack.extend(reversed(x.children))
            else:
                stack.extend(reversed(x.children))
        close()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by line feeds; empty for null, empty and textless pages."""
    if not page:
        return ""
    return "\n".join(_blocks(_chosen(_prune(parse(page)))))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row; null pages give an empty text, repeated rows and null keys stay."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    from cytolith.llm.common import read_table

    return extract(read_table(spark, sf_dir, "pages"))
