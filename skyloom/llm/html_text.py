"""Main text of web pages by composite text density.

Every page becomes a tree of elements.  Scripts, styles, navigation, headers,
footers, sidebars, notices, adverts, forms and comments are cut by element,
role or name.  A DOM node's density is its characters per tag, adjusted by its
links (a text node has no tags, so its density is its characters); the node with
the greatest sum of its children's densities is the main subtree.  The least
density on its way to the body is the threshold that further subtrees must reach;
only elements that repeat a path element's tag and classes beside it are asked, as
parts of one article look alike and teasers do not.  Where the main subtree lies in an
``article`` element, the whole element is taken.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements without content, with raw content, that start a
# block, and the elements that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option legend".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCE = frozenset("table ul ol dl div article section main body html select td th".split())
#: Elements, roles and names that never hold the article.
CUT = frozenset("script style noscript template head title nav header footer aside form button select input textarea iframe object embed svg canvas dialog menu noembed noframes xmp audio video map".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CUT_NAMES = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner promo promotion promotions sponsor sponsored sponsors nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup comment comments commentlist replies respond disqus share sharing social related recommended teaser teasers widget widgets pagination pager login".split())
#: Names of what others wrote or of other articles; what bears one is not the article, though it holds articles.
OTHERS = frozenset("comment comments commentlist replies respond disqus related recommended teaser teasers".split())
#: Words that turn a name into a remark on the element's layout, as in no-sidebar, has-comments or header-fixed.
REMARKS = frozenset("no not non with without has have hide hidden show by is layout page fixed sticky above below after before single left right".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in sorted(RAW)}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element; its children are nodes and strings in page order.  ``cut`` is 1 if only its name says so, 2 for good, 3 if it is named as what others wrote."""

    __slots__ = ("children", "chars", "cut", "density", "kind", "links", "link_chars", "sum", "tag", "tags", "up")

    def __init__(self, tag: str, up: Node | None, cut: int = 0, kind: str = ""):
        self.tag, self.up, self.cut, self.kind, self.children = tag, up, cut, kind, []


def named(value: str, names: frozenset[str] = CUT_NAMES) -> bool:
    """Whether one of a class or id attribute's names says that the element is no part of the article.

    A name counts if its parts between hyphens, underscores and capitals hold one of
    ``names`` and none of them only remarks on the layout.
    """
    for name in value.split():
        parts = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower().replace("_", "-").split("-")
        if any(p in names for p in parts) and not any(p in REMARKS for p in parts):
            return True
    return False


def _attributes(tag: str, text: str) -> tuple[int, str]:
    """How an element is cut by its tag and attributes, and its classes."""
    cut, kind = 2 * (tag in CUT), ""
    for m in _ATTRIBUTE.finditer(text) if text else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            kind = " ".join(sorted(value.split()))
        if tag in ("html", "body", "main"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip().lower() in CUT_ROLES:
            cut = 2
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            cut = 2
        elif name in ("class", "id") and named(value):
            cut = cut or (3 if named(value, OTHERS) else 1)
    return cut, kind


def parse(page: str) -> Node:
    """The page's tree; unclosed and misnested elements are closed as browsers close them, roughly.

    Open elements are counted by tag, anew inside each table cell, so that an end tag
    without its start costs nothing, however deep the page is.
    """
    root = top = Node("html", None)
    at, end = 0, len(page)
    scopes: list[dict[str, int]] = [{}]

    def leave(node: Node) -> None:
        """Closes the open elements up to and with ``node``."""
        nonlocal top
        while True:
            if top.tag in ("td", "th"):
                scopes.pop()
            scopes[-1][top.tag] -= 1
            done = top is node
            top = top.up
            if done:
                return

    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            top.children.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            # An inline end tag reaches no further than its table cell.
            if scopes[-1].get(tag) or tag in BLOCK and any(s.get(tag) for s in scopes):
                node = top
                while node.tag != tag:
                    node = node.up
                leave(node)
            continue
        if tag == "body" and top.tag == "head":
            leave(top)
        close = ("p", *SAME.get(tag, ())) if tag in CLOSES_P else SAME.get(tag, ())
        if any(s.get(c) for c in close for s in scopes[-2:]):
            node, reach = top, None
            while node is not root:
                if node.tag in close:
                    reach = node
                if node.tag in FENCE and node.tag not in close:
                    break
                node = node.up
            if reach is not None:
                leave(reach)
        node = Node(tag, top, *_attributes(tag, m[3]))
        top.children.append(node)
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            node.children.append(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
            if tag in ("td", "th"):
                scopes.append({})
    return root


def _spare(root: Node) -> None:
    """Lifts cuts that would take the article: by name, of an element that holds an ``article``, ``main`` or ``h1``; by tag, of a header in an ``article``.

    An ``article`` that is cut by its own name lifts nothing, and names of comments and
    of other articles stand, whatever they hold.
    """
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.tag == "header" and inside:
            node.cut = 0
        if node.tag in ("article", "main", "h1") and not node.cut:
            up = node.up
            while up is not None and up.cut == 1:
                up.cut = 0
                up = up.up
        if node.cut < 2:
            inside = inside or node.tag == "article"
            stack.extend((c, inside) for c in node.children if isinstance(c, Node))


def _order(root: Node) -> list[Node]:
    """Nodes that are not cut, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.cut)
    return out


def _densities(nodes: list[Node]) -> None:
    """chars, tags and their link shares of every node, then its composite density and density sum.

    The composite density is C/T times the logarithm of (C/LC)(T/LT) to the base
    ln(C/(C-LC) LC + LCb/Cb C + e), where C and T are characters and tags below the
    node, LC and LT those of links, and LCb and Cb the body's; counts of 0 are 1.
    """
    for node in reversed(nodes):
        own = tags = links = link_chars = 0
        chars = 0
        for c in node.children:
            if isinstance(c, str):
                own += len(" ".join(c.split()))
            elif not c.cut:
                chars += c.chars
                tags += 1 + c.tags
                links += c.links
                link_chars += c.link_chars
        node.chars, node.tags, node.sum = own + chars, tags, float(own)
        node.links, node.link_chars = (links + 1, own + chars) if node.tag == "a" else (links, link_chars)
    body = nodes[0]
    linked = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if not node.chars:
            node.density = 0.0
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.links, 1)
        base = math.log(c / max(c - node.link_chars, 1) * lc + linked * c + math.e)
        node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)) / base, 1e-9)
    for node in nodes[1:]:
        node.up.sum += node.density


def _blocks(node: Node, out: list[str]) -> None:
    """Appends the subtree's blocks: text between block boundaries, references decoded, white space joined."""
    piece: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(piece)).split())
        if text:
            out.append(text)
        piece.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            piece.append(x)
        elif x.tag == "br":
            piece.append(" ")
        elif not x.cut or x is node:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by an empty line; empty if there is none."""
    root = parse(page or "")
    _spare(root)
    text = _main(root)
    for level in (1, 3):
        if not text and any(n.cut == level for n in _every(root)):
            # Names alone left nothing, so they did not mean what they said.
            for node in _every(root):
                node.cut = 0 if node.cut == level else node.cut
            text = _main(root)
    return text


def _every(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if isinstance(c, Node))


def _main(root: Node) -> str:
    start = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)
    nodes = _order(start)
    _densities(nodes)
    # Only blocks are candidates: an inline element is part of a paragraph, a paragraph part of a text.
    best = max((n for n in nodes if n.tag in BLOCK and n.tag not in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6") or n is start), key=lambda n: (n.sum, n.chars))
    path = [best]
    while path[-1] is not start:
        path.append(path[-1].up)
    article = next((n for n in reversed(path) if n.tag == "article"), None)
    out = []
    if article is not None:
        _blocks(article, out)
        return "\n\n".join(out)
    threshold = min(n.density for n in path)
    on_path = {id(n): n for n in path}

    def parts(node: Node) -> None:
        """Blocks of ``best`` and of its like beside the path, in page order."""
        stack = [node]
        while stack:
            x = stack.pop()
            if x is best:
                _blocks(x, out)
            elif id(x) in on_path:
                below = next(c for c in x.children if id(c) in on_path)
                like = [c for c in x.children if isinstance(c, Node) and not c.cut and (c is below or c.tag == below.tag and c.kind == below.kind and c.tag in BLOCK and c.chars and c.density >= threshold)]
                stack.extend(reversed(like))
            else:
                _blocks(x, out)

    parts(start)
    return "\n\n".join(out)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages, and pages without text outside cut elements, give an empty
    text.  A page that breaks off is read as far as it goes.  Repeated rows give
    equal results; an empty table gives an empty one; other columns are not looked at.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "id long, url string, text string, n_chars long").select(F.col("id").alias("page_id"), "url", "text", "n_chars")
