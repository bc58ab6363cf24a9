"""Main text of a web page by composite text density (Sun, Song and Liao, SIGIR 2011).

The page is read into a tree. For every node the *composite density* is its characters per tag,
lowered where its text is in links; a node's *density sum* is the sum over its children. The
node of the greatest sum is where the article is: its own paragraphs are dense, and what
surrounds them is not. The least density on the path from that node up to the body is the
threshold: a neighbour of the path at least as dense, and not itself boilerplate, belongs to
the article too, and so does text that stands in the path's nodes directly.

What is never article text is left out before densities are computed: scripts, styles, hidden
elements, navigation, headers (of an article all but its headlines), footers, asides. Forms and blocks whose
class, id or role names adverts, reader comments, cookies and the like go too, unless such a block holds
most of the page's unlinked text and no article outside of it is told (``settle_marks``). Words that also
occur in articles (a section on related work, a discussion, a notice) only weigh: inside the
article such a block stays if it is a paragraph, or long and hardly linked. Inline elements and headings
are never marked. An article inside an article is a reader's comment, by the HTML standard, if it is no longer
than the outer one's own text; one that is mostly links, beside others that are not, a teaser. The outermost ``article`` around the chosen node (or else ``main``) is taken
whole, so that its headline and short paragraphs stay; in a ``main`` around it the path goes on.

At scale: one pass over the rows, no shuffle. The tree is walked without recursion, so depth
is no limit; a page is read in time proportional to its length.

Defined results: null, empty or text-free pages give the empty string. Text is decoded, white
space in a block becomes one space, blocks are joined by one. Repeated rows are read one by one.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from html import unescape
from html.parser import HTMLParser
from math import e, log

from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from .batches import Texts, extend, hidden

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_TEXT = frozenset(
    "head script style noscript template iframe object svg math canvas audio video map "
    "button select textarea input label datalist "
    "nav header footer aside menu dialog".split()
)
#: Elements that are boilerplate like blocks marked by their class.
MARKED = frozenset("form fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt rtc ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Block elements whose start closes an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An element's start closes an open one of these, up to the scope named.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
#: Words in a class, id or role that mark boilerplate.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|"
    r"aside|footer|masthead|comment\w*|disqus|replies|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w*|signup|"
    r"widget\w*|pagination|pager|toolbar|contentinfo|navigation|complementary)(?:$|[\s_-])",
    re.I,
)
#: Whole names that mark boilerplate around articles, and may be used in one.
DOUBTFUL = frozenset(
    "side header reply respond discussion notice notices alert overlay share sharing social related recommended recommendations "
    "login search copyright disclaimer legal related-posts related-articles related-links related-stories share-buttons social-links".split()
)
#: Unlinked characters from which a block of a doubtful name inside an article is text.
LEAST_TEXT = 140
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Ends of a comment, and what closes one right after its start.
COMMENT_END = re.compile(r"--(?:!|\s*)>")
COMMENT_AT_ONCE = re.compile("-?>")
CONTAINERS = ("article", "main")
HEADLINES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Share of the page's unlinked text from which an unmarked article or main is taken for the page's own.
ARTICLE_SHARE = 0.1


#: Elements whose start closes an open one, by the element that is open: what it closes up to.
_OPEN = [(("p",), ("table", "td", "th", "button", "object")), *dict.fromkeys(CLOSES.values())]
_GROUP = {**dict.fromkeys(CLOSES_P, 0), **{tag: _OPEN.index(rule) for tag, rule in CLOSES.items()}}
_SETS = {t: [k for k, (tags, _) in enumerate(_OPEN) if t in tags] for tags, _ in _OPEN for t in tags}
_CLEARS = {t: [k for k, (_, stops) in enumerate(_OPEN) if t in stops] for _, stops in _OPEN for t in stops}


class Node:
    __slots__ = (
        "base", "chars", "density", "doubtful", "inline", "items", "links", "link_chars", "marked", "only_headlines", "open", "parent",
        "skip", "tag", "tags", "total",
    )

    def __init__(self, tag: str, parent: Node | None, skip: bool, marked: bool = False, doubtful: bool = False):
        self.tag, self.parent, self.skip, self.marked, self.doubtful = tag, parent, skip, marked, doubtful
        self.only_headlines = False
        self.items: list[Node | str] = []  # text and elements in page order
        self.chars = self.tags = self.links = self.link_chars = 0
        self.density = self.total = 0.0
        # the nearest open element of each rule of _OPEN, and the block around with its open inline elements
        self.open: tuple[Node | None, ...] = parent.open if parent is not None else (None,) * len(_OPEN)
        if tag in _SETS or tag in _CLEARS:
            known = list(self.open)
            for k in _CLEARS.get(tag, ()):
                known[k] = None
            for k in _SETS.get(tag, ()):
                known[k] = self
            self.open = tuple(known)
        within = parent is not None and tag in INLINE
        self.base: Node = parent.base if within else self
        self.inline: dict[str, int] | None = None if within else {}


class Tree(HTMLParser):
    """Elements as a tree, end tags that are missing implied as browsers do.

    Every element is opened and closed once, and whether an end tag or an implied end finds an open
    element is known without a search, so that depth costs nothing.
    """

    open_ended = ("textarea", "title")
    CDATA_CONTENT_ELEMENTS = ("script", "style", *open_ended)

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.closing = False
        self.root = self.here = Node("#root", None, False)
        self.order = [self.root]
        self.opened: dict[str, int] = {}  # elements open, by tag

    def _enter(self, node: Node) -> None:
        self.here = node
        self.opened[node.tag] = self.opened.get(node.tag, 0) + 1
        if node.base is not node:
            node.base.inline[node.tag] = node.base.inline.get(node.tag, 0) + 1

    def _leave(self, to: Node) -> None:
        """Close what is open up to and with the child of ``to``."""
        while self.here is not to:
            node = self.here
            self.opened[node.tag] -= 1
            if node.base is not node:
                node.base.inline[node.tag] -= 1
            self.here = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _GROUP:
            ended = self.here.open[_GROUP[tag]]
            if ended is not None:
                self._leave(ended.parent)
        if tag in ("html", "body") and any(n.tag == tag for n in self.order[:4]):
            return  # a second one only adds attributes
        names = [value for name, value in attrs if name in ("class", "id", "role") and value]
        marks = " ".join(names) if tag not in INLINE and tag not in HEADLINES and tag not in ("html", "body", "main") else ""
        marked = tag in MARKED or bool(marks and BOILERPLATE.search(marks))
        doubtful = not marked and tag != "article" and any(t.lower() in DOUBTFUL for t in marks.split())
        headed = tag == "header" and (self.opened.get("article") or self.opened.get("main"))
        hidden_by = any(name == "hidden" or name == "style" and value and HIDDEN.search(value) for name, value in attrs)
        node = Node(tag, self.here, tag in NEVER_TEXT and not headed or hidden_by, marked, doubtful)
        node.only_headlines = tag not in HEADLINES and bool(headed or self.here.only_headlines)
        self.here.items.append(node)
        self.order.append(node)
        if tag not in VOID:
            self._enter(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if not self.opened.get(tag) or tag in INLINE and not self.here.base.inline.get(tag):
            return  # nothing to close, or only beyond a block, which a stray inline end tag does not close
        node = self.here
        while node.tag != tag:
            node = node.parent
        self._leave(node.parent)

    def close(self):
        self.closing = True
        super().close()

    def parse_comment(self, i, report=1):
        """The end of a comment, closed as browsers close it or, on close(), reaching to the end."""
        end = COMMENT_AT_ONCE.match(self.rawdata, i + 4) or COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata) if self.closing else -1

    def set_cdata_mode(self, elem):
        if elem in self.open_ended and f"</{elem}" not in self.rawdata.lower():
            self.CDATA_CONTENT_ELEMENTS = ("script", "style")  # never closed: read on as elements
        else:
            super().set_cdata_mode(elem)

    def handle_data(self, data):
        if not self.here.only_headlines:
            self.here.items.append(unescape(data) if self.here.tag == "title" else data)


def measure(order: list[Node]) -> None:
    """Characters, tags and link shares of every node, from the leaves up."""
    for node in reversed(order):  # children come after their parents
        if node.skip:
            continue
        for item in node.items:
            if isinstance(item, str):
                node.chars += len("".join(item.split()))
            elif not item.skip:
                node.chars += item.chars
                node.tags += item.tags + 1
                node.links += item.links + (item.tag == "a")
                node.link_chars += item.chars if item.tag == "a" else item.link_chars


def settle_marks(order: list[Node]) -> None:
    """Skip marked blocks, but for those that hold most of the page's unlinked text.

    Where an article or main outside of them, or else inside such large ones alone, has a fair share of
    it, only the blocks around it stay: what else is marked there, however long, is about the article
    (comments, say). If nothing else is left, no block is skipped for its mark.
    """
    full: dict[int, int] = {}  # unlinked characters below a node
    whole: dict[int, int] = {}  # all of them
    plain: dict[int, int] = {}  # the same without marked blocks
    for node in reversed(order):
        if not node.skip:
            whole[id(node)] = sum(len("".join(i.split())) if isinstance(i, str) else whole.get(id(i), 0) for i in node.items)
        for item in node.items if node.tag != "a" and not node.skip else ():
            held = isinstance(item, Node)
            n = full.get(id(item), 0) if held else len("".join(item.split()))
            full[id(node)] = full.get(id(node), 0) + n
            unmarked = (0 if item.marked or item.doubtful else plain.get(id(item), 0)) if held else n
            plain[id(node)] = plain.get(id(node), 0) + unmarked
    total, left = full.get(id(order[0]), 0), plain.get(id(order[0]), 0)
    most = lambda node: 2 * full.get(id(node), 0) > total

    def article(inside_most: bool) -> Node | None:
        """The largest article or main with a fair share, outside of marked blocks but those allowed."""
        covered, best = set(), None
        for node in order:  # parents come before their children
            closed = node.skip or node.marked and not (inside_most and most(node))
            if node.parent is not None and (closed or id(node.parent) in covered):
                covered.add(id(node))
            elif node.tag in CONTAINERS and (best is None or plain.get(id(node), 0) > plain.get(id(best), 0)):
                best = node
        return best if best is not None and plain.get(id(best), 0) >= max(ARTICLE_SHARE * total, 1) else None

    told = article(False) or article(True)
    around, within = set(), set()
    node = told
    while node is not None:
        around.add(id(node))
        node = node.parent
    for node in order:
        if told is not None and (node is told or node.parent is not None and id(node.parent) in within):
            within.add(id(node))
        if id(node) in around:
            continue
        if node.marked and (told is not None or left and not most(node)):
            node.skip = True
        elif node.doubtful and told is not None:
            text = full.get(id(node), 0)
            is_text = node.tag == "p" or text >= LEAST_TEXT and 3 * text > 2 * whole.get(id(node), 0)
            node.skip = node.skip or not (id(node) in within and is_text)
        elif node.doubtful and left and not most(node):
            node.skip = True


def settle_nested(order: list[Node]) -> None:
    """Skip articles inside an article that are no longer than its own text."""
    own: dict[int, int] = {}  # of each article, characters outside of inner ones
    outer: dict[int, Node | None] = {}  # the article around, itself included
    for node in order:  # parents come before their children
        above = outer.get(id(node.parent)) if node.parent is not None else None
        outer[id(node)] = node if node.tag == "article" else above
        if outer[id(node)] is not None and not node.skip and node.tag != "a":
            at = id(outer[id(node)])
            own[at] = own.get(at, 0) + sum(len("".join(i.split())) for i in node.items if isinstance(i, str))
    for node in order:
        around = outer.get(id(node.parent)) if node.tag == "article" and node.parent is not None else None
        if around is not None and own.get(id(around), 0) >= own.get(id(node), 0):
            node.skip = True


def score(order: list[Node], body: Node) -> None:
    """Composite density of every node, and the sum over its children."""
    body_share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        if node.skip or not node.chars:
            continue
        chars, tags = node.chars, max(node.tags, 1)
        links, linked = max(node.links, 1), max(node.link_chars, 1)
        base = log(chars / max(chars - node.link_chars, 1) * node.link_chars + body_share * chars + e)
        ratio = chars / linked * (tags / links)
        node.density = chars / tags * max(log(max(ratio, 1.0)) / base, 0.0) if node.links else chars / tags
        node.total = sum(i.density for i in node.items if isinstance(i, Node) and not i.skip)
        # text of the node's own counts like that of a child without tags
        node.total += sum(len("".join(i.split())) for i in node.items if isinstance(i, str))


def _inherit_skips(order: list[Node]) -> None:
    for node in order:  # parents come before their children
        node.skip = node.skip or node.parent is not None and node.parent.skip


def chosen(order: list[Node]) -> list[Node | str]:
    """The subtrees and texts that make up the article, in page order."""
    body = next((n for n in order if n.tag == "body"), order[0])
    settle_marks(order)
    settle_nested(order)
    _inherit_skips(order)
    measure(order)
    articles = [n for n in order if n.tag == "article" and not n.skip and n.chars]
    teasers = [n for n in articles if 2 * n.link_chars > n.chars]
    if 0 < len(teasers) < len(articles):
        for node in teasers:
            node.skip = True
        _inherit_skips(order)
        for node in order:
            node.chars = node.tags = node.links = node.link_chars = 0
        measure(order)
    score(order, body)
    inside = [n for n in order if not n.skip and n.chars and n.tag not in INLINE]
    if not inside:
        return []
    best = max(inside, key=lambda n: n.total)
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    articles = [n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"]
    whole = articles[-1] if articles else best  # the outermost
    around = [k for k, n in enumerate(path) if n.tag in CONTAINERS]
    at, last = path.index(whole), around[-1] if around else len(path) - 1
    before: list[list[Node | str]] = []
    after: list[Node | str] = []
    for child, node in zip(path[at:last], path[at + 1 : last + 1], strict=True):
        k = next(k for k, i in enumerate(node.items) if i is child)
        before.append(_beside(node.items[:k], threshold, bool(around)))
        after += ["\n", *_beside(node.items[k + 1 :], threshold, bool(around))]
    first = [i for items in reversed(before) for i in (*items, "\n")]
    return [*first, whole, *after]


def _beside(items: list[Node | str], threshold: float, in_container: bool) -> list[Node | str]:
    """What of the neighbours of the path belongs to the article: dense blocks, in an article or main
    also headlines and further articles, and the path node's own text and inline elements, whose density
    is the node's, unless links are most of it."""
    found: list[Node | str] = []
    run: list[Node | str] = []
    for item in (*items, None):
        if isinstance(item, str) or item is not None and item.tag in INLINE:
            run.append(item)
            continue
        chars = sum(len("".join(i.split())) if isinstance(i, str) else i.chars for i in run)
        linked = sum(i.chars if i.tag == "a" else i.link_chars for i in run if isinstance(i, Node))
        if 2 * linked < chars:
            found += run
        run = []
        if item is not None and not item.skip and item.chars:
            titled = _headline(item, HEADLINES if in_container else ("h1",))
            further = in_container and item.tag == "article" and 2 * item.link_chars < item.chars
            dense = item.density >= threshold and 2 * item.link_chars < item.chars
            found += [item] if titled or further or dense else ["\n"]
    return found


def _headline(node: Node, tags: Collection[str]) -> bool:
    """Whether all text of the node is that of one headline."""
    while node.tag not in tags:
        filled = [i for i in node.items if (i.strip() if isinstance(i, str) else not i.skip and i.chars)]
        if len(filled) != 1 or isinstance(filled[0], str):
            return False
        node = filled[0]
    return 2 * node.link_chars < node.chars


def text_of(items: list[Node | str]) -> str:
    """All text of items and below them but that of skipped elements; blocks end words."""
    parts: list[str] = []
    stack: list[Node | str] = items[::-1]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.skip:
            if item.tag in INLINE:
                stack.extend(reversed(item.items))
            else:
                parts.append("\n")
                stack.append("\n")
                stack.extend(reversed(item.items))
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return text_of(chosen(tree.order))


def extract(pages: DataFrame, *, html_col: str = "html") -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with the main text and its length, and the names the new columns got."""
    names = dict(zip(("text", "n_chars"), hidden(pages, "text", "n_chars"), strict=True))
    fields = [StructField(names["text"], StringType()), StructField(names["n_chars"], LongType())]

    def start():
        def work(texts: Texts):
            found = [main_text(None if t is None else t.decode()) for t in texts]
            return found, [len(t) for t in found]

        return work

    return extend(pages, html_col, fields, start), names
