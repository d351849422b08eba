"""Main text of web pages by composite text density.

Every element of a page gets its characters per tag, adjusted by how much of its text stands in
links. A block element's density sum is the sum over its block children. The
subtree with the largest sum is the article; the least density on the path from it up to the body is
the threshold that other subtrees along that path must reach to join it. If the article lies in
an ``article`` or ``main`` element, all of that element is taken.

Elements that are never article text are left out beforehand: scripts, styles, menus, page headers
and footers, asides, forms, hidden parts, and elements named by class, id or role as adverts,
notices, side bars, comments and the like. Neither a name nor a form counts on an element that wraps the
article, or that holds most of the page's text outside links while no other article is marked; names behind
``has``, ``no``, ``with`` and ``without`` say what an element is not. Tags may be left open, cut off or misnested: paragraphs, items and cells close
each other, stray end tags are ignored, and what is open at the end of the page is closed there.

Null, empty and text-free pages give an empty text. Character references are decoded, white space
inside a block becomes one space, and blocks are joined by a line feed in page order. Rows
that repeat give equal rows; extra columns are dropped unless asked for.
"""

from __future__ import annotations

import html
import itertools
import math
import re

from pyspark.sql import DataFrame

from serieslake.llm.common import with_columns_of_text

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
_IGNORED = {"html", "head", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# start tag -> the open elements that it closes, and the elements it does not look beyond
_CELLS, _ROWS = {"td", "th", "p"}, {"tr", "caption"}
_GROUPS = {"tbody", "thead", "tfoot"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
    "tr": (_CELLS | _ROWS, {"table", *_GROUPS}),
    "tbody": (_CELLS | _ROWS | _GROUPS, {"table"}),
    "thead": (_CELLS | _ROWS | _GROUPS, {"table"}),
    "tfoot": (_CELLS | _ROWS | _GROUPS, {"table"}),
    "option": ({"option"}, {"select"}),
}
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section summary table ul".split()
)
_SHELTERS = {"table", "td", "th", "caption", "button", "object"}
_TABLE_PARTS = {"table", "tr", "td", "th", "caption", *_GROUPS}

_NEVER = _RAW | set("nav footer aside form button select fieldset dialog menu canvas audio video search datalist svg math object".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidenav nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond reply replies cookie cookies consent "
    "gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget pagination pager skip copyright paywall".split()
)
_ARTICLES = {"article", "main"}
_ABOUT_OTHERS = {"has", "no", "with", "without"}  # has-sidebar, no-comments


class _Node:
    __slots__ = ("tag", "parent", "content", "noise", "named", "hidden", "chars", "links", "tags", "link_tags", "density", "sum", "open")

    def __init__(self, tag: str, parent: "_Node | None"):
        self.tag, self.parent = tag, parent
        self.content: list = []  # elements and strings in page order
        self.noise, self.named, self.hidden = tag in _NEVER, False, False
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.open: frozenset[str] = frozenset()  # the tags of the element and of those around it, without the body's

    def within(self, tags: set[str]) -> "_Node | None":
        """The nearest element with one of the tags, itself included."""
        node = self
        while node is not None and node.tag not in tags:
            node = node.parent
        return node


def _is_noise(name: str) -> bool:
    """Whether a class or id names an advert, a side bar or the like."""
    words = (w.lower() for w in _WORDS.findall(name))
    return not _NOISE.isdisjoint(itertools.takewhile(lambda w: w not in _ABOUT_OTHERS, words))


def _mark(node: _Node, attributes: str) -> None:
    """Note what the attributes say about an element."""
    for name, *values in _NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            node.hidden = True
        elif name == "style":
            node.hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "role":
            node.hidden |= value.lower() in _ROLES
            if value.lower() in _ARTICLES:
                node.tag = value.lower()
        elif name in ("class", "id"):
            node.named |= any(map(_is_noise, value.split()))
    node.noise |= node.hidden


def _before(node: _Node, tag: str) -> _Node:
    """The open element that a start tag falls into, once it has closed what it closes."""
    closed, shelters = _CLOSES.get(tag, ({"p"} if tag in _CLOSES_P else (), _SHELTERS))
    if not node.open.isdisjoint(closed):
        up, into = node, node
        while up.parent is not None and up.tag not in shelters:
            if up.tag in closed:
                into = up.parent
                if tag in ("li", "dt", "dd", "option"):
                    break
            up = up.parent
        node = into
    return node.parent if tag in _HEADINGS and node.tag in _HEADINGS else node


def _after(node: _Node, tag: str) -> _Node:
    """The open element once an end tag is read; an end tag without a start changes nothing."""
    if tag not in node.open:
        return node
    up = node
    while up.parent is not None and up.tag != tag:
        if tag in _INLINE and up.tag not in _INLINE or up.tag in _SHELTERS and tag not in _TABLE_PARTS:
            return node
        up = up.parent
    return up.parent if up.parent is not None else node


def _tree(page: str) -> list[_Node]:
    """The elements of a page, each after its parent; the first one is the body."""
    nodes = [_Node("body", None)]
    node, at, end = nodes[0], 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            node.content.append(page[at:stop])
        if not found:
            break
        at = found.end()
        tag = (found["start"] or found["end"] or "").lower()
        if not tag or tag in _IGNORED:
            continue
        if found["end"]:
            node = _after(node, tag)
            continue
        parent = _before(node, tag)
        child = _Node(tag, parent)
        _mark(child, found["attributes"])
        child.open = parent.open if child.tag in parent.open else parent.open | {child.tag}
        parent.content.append(child)
        nodes.append(child)
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            at = close.end()
            node = parent
        else:
            node = parent if tag in _VOID else child
    return nodes


def _text(piece: str) -> str:
    return html.unescape(piece) if "&" in piece else piece


def _measure(nodes: list[_Node]) -> None:
    """Characters, tags and links below every element that is no noise."""
    for node in reversed(nodes):
        for piece in node.content:
            if isinstance(piece, str):
                node.chars += len(" ".join(_text(piece).split()))
            elif not piece.noise:
                node.chars += piece.chars
                node.links += piece.links
                node.tags += 1 + piece.tags
                node.link_tags += piece.link_tags + (piece.tag == "a")
        if node.tag == "a":
            node.links = node.chars


def _holders(nodes: list[_Node]) -> set[_Node]:
    """Named elements and forms that hold most of the page's text outside links, unless an article is marked elsewhere."""
    if not any(node.named or node.tag == "form" for node in nodes):
        return set()
    out = {node: node.hidden or (node.noise and node.tag != "form") for node in nodes}  # whatever its name and size
    for node in nodes[1:]:
        out[node] |= out[node.parent]
    prose, articles = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node in reversed(nodes):
        if out[node] or node.tag == "a":
            continue
        articles[node] += node.tag in _ARTICLES and not node.named
        prose[node] += sum(len(" ".join(_text(piece).split())) for piece in node.content if isinstance(piece, str))
        if node.parent is not None:
            prose[node.parent] += prose[node]
            articles[node.parent] += articles[node]
    body = nodes[0]
    return {
        node
        for node in nodes
        if (node.named or node.tag == "form") and 2 * prose[node] > prose[body] and (articles[node] or not articles[body])
    }


def _drop_noise(nodes: list[_Node]) -> None:
    """Named elements and page headers are noise unless they wrap the article or most of the text."""
    _measure(nodes)
    total = nodes[0].chars
    wraps, around = _holders(nodes), set()
    for node in nodes:
        if node.tag in _ARTICLES and not node.named and not node.noise and 2 * node.chars > total:
            up = node.parent
            while up is not None and up not in around:
                around.add(up)
                up = up.parent
    wraps |= around
    for node in nodes:
        if node.tag in _RAW or node is nodes[0]:
            continue
        if node.tag == "header":
            node.noise |= node.parent.within(_ARTICLES) is None
        elif node.tag in _HEADINGS and node.named:
            continue
        node.noise |= node.named and not (node.tag == "header" and not node.noise)
        if node in wraps:
            node.noise = False
    for node in nodes:
        if node.parent is not None and node.parent.noise:
            node.noise = True
        node.chars = node.links = node.tags = node.link_tags = 0
    _measure(nodes)


def _weigh(nodes: list[_Node]) -> None:
    """Composite text density of every element, and the sum over its block children."""
    body = nodes[0]
    linked = body.links / max(body.chars, 1)
    for node in reversed(nodes):
        if node.noise or not node.chars:
            continue
        c, t = node.chars, max(node.tags, 1)
        base = 1 + math.log(c / max(c - node.links, 1) * node.links + linked * c + math.e)
        node.density = max(c / t * math.log(c / max(node.links, 1) * t / max(node.link_tags, 1)) / math.log(base), 0.0)
        if node.tag not in _INLINE and node.parent is not None:
            up = node.parent
            while up.parent is not None and up.tag in _INLINE:
                up = up.parent
            up.sum += node.density


def _chosen(nodes: list[_Node]) -> list[_Node]:
    """The subtrees that make up the article."""
    body = nodes[0]
    live = [n for n in nodes if not n.noise and n.chars]
    if not live:
        return []
    best = max(live, key=lambda n: n.sum)
    if best.sum <= 0:
        return [body]
    holder = best.within({"article"}) or best.within({"main"})
    if holder is None:
        marked = [n for n in live if n.tag in _ARTICLES and 2 * n.chars > body.chars]
        holder = marked[-1] if marked else None
    if holder is not None:
        return [holder]
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path)
    chosen, on_path = {id(best)}, {id(n) for n in path}
    for node in path[1:]:
        for piece in node.content:
            if not isinstance(piece, str) and id(piece) not in on_path and not piece.noise and piece.chars:
                if piece.density >= threshold and 2 * piece.links < piece.chars:
                    chosen.add(id(piece))
    return [n for n in nodes if id(n) in chosen]


def _blocks(top: _Node) -> list[str]:
    """The texts of the blocks below an element, in page order."""
    blocks, words = [], []

    def flush():
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    todo: list = [top]
    while todo:
        piece = todo.pop()
        if piece is None:
            flush()
        elif isinstance(piece, str):
            words.append(_text(piece))
        elif not piece.noise:
            if piece.tag not in _INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(piece.content))
    flush()
    return blocks


def extract(page: str) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes = _tree(page)
    _drop_noise(nodes)
    _weigh(nodes)
    return "\n".join(block for top in _chosen(nodes) for block in _blocks(top))


def main_text(pages: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) with the main ``text`` of each page and its ``n_chars``."""

    def extracted(texts):
        found = [extract(t) for t in texts]
        return found, [len(t) for t in found]

    return with_columns_of_text(pages, columns, "text string, n_chars bigint", extracted, text="html")
