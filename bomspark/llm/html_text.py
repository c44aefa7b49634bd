"""Main-text extraction by composite text density.

Each page's html becomes a tree of elements. Elements that never hold article text (scripts,
hidden parts) are cut off first, then those that doubtful names or tags speak against, unless
what they hold speaks for them (``_cut``): adverts, comments and notices by a word of class, id or
role, or by a part of one where the element holds less than half of the page's text outside
links; menus, headers, sidebars and such by their tag or a word, unless nearly all of that text is
theirs in paragraphs; forms with no article and at most half of it; and what a part of a word
calls a menu or the like, if it is mostly links. No rule looks at lengths, only at shares.
A header within an article stays if it has a heading. For every node the density is its characters per tag, adjusted for link
characters; a node's density sum adds up its children's densities. From the body down, a
node above the threshold (the least density on the path from the body to the node of
maximum density sum) yields its maximum-sum subtree as content, and so does every child
beside that subtree, all the way down. The subtrees are joined in page order, with the
headings right before them and with what stands between two of them in one parent, unless
links hold most of it.

Defined results: null, empty or text-free html gives an empty text. Markup may be cut off
anywhere; unclosed elements end with their parent; once a tag's quotes run to the end of the
page, tags end at the next sign that closes them. Texts are never cut, and pages of any
length take time in proportion to it. Of subtrees that tie the first counts. Repeated rows
are extracted alike. A page without a body element is its own body. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)")
ATTRS = re.compile(r"""(?>[^>"']+|"[^"]*"|'[^']*'|["'])*+(?=>)""")
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\s(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
#: Borders within a name: other signs, and where an upper-case letter follows a lower-case one.
PARTS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
RAW = frozenset({"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
DROPPED = frozenset({"script", "style", "title", "head", "iframe", "textarea", "noscript", "template", "button", "select", "svg", "canvas", "object", "noembed", "noframes", "xmp", "audio", "video", "datalist"})
#: Elements that are cut by their text.
SELDOM = frozenset({"nav", "header", "footer", "aside", "dialog", "menu"})
BLOCK = frozenset({"address", "article", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "header", "footer", "nav", "aside", "form", "hgroup", "caption"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Words in class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert comment comments commentlist disqus reply replies respond sidebar sidebars widget widgets related recommended share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead topbar newsletter subscribe subscription signup login popup modal overlay paywall toolbar search contentinfo complementary form".split()
)
#: Those of them that name adverts, reader comments and notices, and no part of a layout.
STRONG = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr notice notices comment comments commentlist disqus reply replies respond newsletter subscribe subscription popup paywall".split())
#: Parts that turn a name into a statement on the page, as in no-sidebar.
FLAGS = frozenset("no not without with has have enabled disabled open closed on off".split())
#: Words that name an article's wrapper: names beside them are no more than a hint.
CONTENT = frozenset("article post entry content story main text body hentry".split())
#: How much speaks against an element: by a part of a name, by a part that names an advert or the
#: like, by its tag or a whole word, by such a word that names an advert or the like.
HINT, PART, WORD, CERTAIN = 1, 2, 3, 4
#: An open element of the key ends where an element of the value starts.
CLOSES = {"p": BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "h1": {"h2", "p"}, "h2": {"h1", "h2", "h3", "p"}, "h3": {"h2", "h3", "h4", "p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"td", "th", "li", "div", "article", "section", "blockquote", "body", "main"}, "option": {"select"}}
#: Per name, the elements that its start may end.
ENDS = {name: [k for k, v in CLOSES.items() if name in v] for name in frozenset().union(*CLOSES.values())}


class Node:
    __slots__ = ("name", "parent", "items", "off", "doubt", "kids", "chars", "tags", "link_chars", "link_tags", "density", "total", "top", "marked", "holds")

    def __init__(self, name: str, parent: Node | None, off: bool = False, doubt: int = 0):
        self.name, self.parent, self.off, self.doubt = name, parent, off, doubt
        self.items: list[Node | str] = []
        self.kids: list[Node] = []


@lru_cache(maxsize=1 << 14)
def _named(marks: str) -> int:
    """How much an element's names speak against it."""
    doubt, words = 0, marks.split()
    for word in words:
        if word.lower() in BOILERPLATE - {"form"}:
            doubt = max(doubt, CERTAIN if word.lower() in STRONG else WORD)
            continue
        parts = set(PARTS.sub("-", word).lower().split("-"))
        if parts.isdisjoint(FLAGS) and not parts.isdisjoint(BOILERPLATE):
            doubt = max(doubt, HINT if parts.isdisjoint(STRONG) else PART)
    return HINT if doubt and not CONTENT.isdisjoint(w.lower() for w in words) else doubt


def _signs(name: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is off whatever it holds, and how much speaks against it."""
    if name in DROPPED:
        return True, 0
    doubt = WORD if name in SELDOM else PART if name == "form" else 0
    if not attrs or name in ("html", "body", "main"):
        return False, doubt
    named = _named(" ".join(m[1] or m[2] or m[3] or "" for m in MARK.finditer(attrs)))
    if name == "article":
        return False, named if named == CERTAIN else 0
    return HIDDEN.search(attrs) is not None, max(doubt, named)


class _Open:
    """The open elements, with their places by name, so that each start or end takes constant time."""

    def __init__(self) -> None:
        self.stack, self.places, self.barriers = [Node("#root", None)], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK and node.name not in CLOSES:
            self.barriers.append(len(self.stack))
        self.stack.append(node)

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            self.places[self.stack.pop().name].pop()
            if self.barriers[-1] == len(self.stack):
                self.barriers.pop()

    def last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def imply_ends(self, name: str) -> None:
        """Closes what a start of ``name`` ends, within the nearest block or scope."""
        while (at := self.last(ENDS.get(name, ()))) > max(self.barriers[-1], self.last(SCOPES.get(name, ()))):
            closed = self.stack[at].name
            self.cut(at)
            if closed not in ("tr", "td", "th"):
                break


def parse(page: str) -> Node:
    """The element tree, by one scan ahead; text directly in a node stands among its items."""
    open_ = _Open()
    at = text_from = 0
    end, last_end = len(page), page.rfind(">")
    sections = quoted = True  # until a section's end, or a tag's beside quotes, isn't found
    while (start := page.find("<", at)) >= 0 and (start <= last_end or page.startswith("<!--", start)):
        at, m = start + 1, None
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = close + 3 if close >= 0 else end
        elif sections and page.startswith("<![CDATA[", start):
            close = page.find("]]>", start + 9)
            sections = close >= 0
            at = close + 3 if sections else page.index(">", start) + 1
        elif page.startswith(("<!", "<?"), start):
            at = page.index(">", start) + 1
        elif m := TAG.match(page, start):
            attrs = ATTRS.match(page, m.end()) if quoted else None
            quoted = attrs is not None
            at = (attrs.end() if attrs else page.index(">", m.end())) + 1
        else:
            continue  # a bare sign, part of the text
        if start > text_from:
            open_.stack[-1].items.append(page[text_from:start])
        text_from = at
        if m is None:
            continue
        name, attrs = m["name"].lower(), page[m.end() : at - 1]
        if m["end"]:
            if open_.places.get(name):
                open_.cut(open_.last([name]))
            continue
        open_.imply_ends(name)
        here = open_.stack[-1]
        child = Node(name, here, *_signs(name, attrs))
        here.items.append(child)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = text_from = close.end() if close else end
        elif name not in VOID and not attrs.endswith("/"):
            open_.push(child)
    if text_from < end:
        open_.stack[-1].items.append(page[text_from:])
    return open_.stack[0]


def _count(root: Node) -> list[Node]:
    """Characters, of all and in links, bottom-up; returns nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.kids = [x for x in node.items if isinstance(x, Node) and not x.off]
        stack.extend(reversed(node.kids))
    for node in reversed(order):
        own = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        node.chars = own + sum(k.chars for k in node.kids)
        node.link_chars = node.chars if node.name == "a" else sum(k.link_chars for k in node.kids)
    return order


def _cut(root: Node) -> None:
    """Cuts off the doubtful elements that their text doesn't speak for."""
    order = _count(root)
    inside: dict[Node, set[str]] = {}
    for node in reversed(order):  # which of these names stand below
        names = {n for k in node.kids for n in (k.name, *inside.get(k, ())) if n in HEADINGS or n in ("main", "article", "p")}
        if names:
            inside[node] = names
    page = root.chars - root.link_chars
    articles = {root: False}
    for node in order:
        above = articles.setdefault(node, node.parent is not None and (articles[node.parent] or node.parent.name in ("main", "article")))
        if not node.doubt:
            continue
        text, names = node.chars - node.link_chars, inside.get(node, set())
        if node.name == "header" and above and text > 0 and not names.isdisjoint(HEADINGS):
            continue
        share = text / page if page else 0.0
        if node.doubt == CERTAIN:
            node.off = "main" not in names
        elif node.doubt == WORD:
            node.off = "main" not in names and (share < 0.8 or names.isdisjoint({"p", "article", *HEADINGS}))
        elif node.doubt == PART:
            held = {"main", "article"} if node.name == "form" else {"main"}
            node.off = names.isdisjoint(held) and share <= 0.5
        else:
            node.off = 2 * node.link_chars > node.chars and names.isdisjoint({"main", "article"}) and share <= 0.5


def _measure(root: Node) -> list[Node]:
    """Counts, densities and density sums bottom-up; returns nodes in page order."""
    order = _count(root)
    for node in reversed(order):
        node.tags = sum(k.tags + 1 for k in node.kids)
        node.link_tags = sum(k.link_tags + (k.name == "a") for k in node.kids)
    body = next((n for n in order if n.name == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c * lc / max(c - lc, 1) + ratio * c + math.e)
            node.density = max(c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(base) if base > 1.0001 else c / t, 0.0)
        node.total = sum(k.density for k in node.kids)
        node.marked = node.holds = False
        node.top = max((node, *(k.top for k in node.kids)), key=lambda n: n.total)
    return order


def _mark(body: Node) -> None:
    """Marks the content's subtrees and, with ``holds``, all nodes above them up to the body."""
    threshold, node = body.top.density, body.top
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and not node.marked and node.chars:
            top = node.top if node.top.total > 0 else node
            top.marked = True
            while top is not body and not top.holds:
                top.holds = True
                top = top.parent
            top.holds = True
        if not node.marked:
            stack.extend(reversed(node.kids))


def _chosen(node: Node) -> Iterator[tuple[Node | str, bool]]:
    """The items of a node above marked ones that may hold content, and whether they are content as a whole."""
    items = [x for x in node.items if isinstance(x, str) or not x.off]
    held = [i for i, x in enumerate(items) if isinstance(x, Node) and x.holds]
    first, last = held[0], held[-1]
    while first and (items[first - 1].name in HEADINGS if isinstance(items[first - 1], Node) else not items[first - 1].strip()):
        first -= 1
    for x in items[first : last + 1]:
        if isinstance(x, Node) and x.holds:
            yield x, x.marked
        elif isinstance(x, str) or 2 * x.link_chars <= x.chars:
            yield x, True


def _text(body: Node) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        words = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if words:
            blocks.append(words)

    stack: list[tuple[Node | str | None, bool]] = [(body, body.marked)]
    while stack:
        item, whole = stack.pop()
        if item is None:
            end_block()
        elif isinstance(item, str):
            line.append(item)
        elif not item.off:
            if item.name in BLOCK:
                end_block()
                stack.append((None, False))
            elif item.name == "br":
                line.append(" ")
            stack.extend(reversed([(x, True) for x in item.items] if whole else [*_chosen(item)]))
    end_block()
    return "\n".join(blocks)


def extract(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    root = parse(page)
    _cut(root)
    order = _measure(root)
    body = next((n for n in order if n.name == "body"), root)
    if not body.chars:
        return ""
    _mark(body)
    return _text(body)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(extract, na_action=None)

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text(F.coalesce(F.col(html), F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
