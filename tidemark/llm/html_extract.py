"""Main text of web pages by composite text density.

The page becomes a tree. Elements that are never content by their tag, role or class names are left out first. Each
node's composite density is its characters per tag, adjusted by the share and the spread of characters inside links;
a node's density sum is that of its children. The node of the largest sum marks the content; the smallest density on
its path to the body is the threshold, and from the body down every child at or above it gives the node with the
largest sum inside it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav footer aside form button select option object svg math canvas audio video map dialog menu fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph, and those that end an open element of a kind up to the nearest holder.
ENDS_P = BLOCK - frozenset("body html tbody td tfoot th thead tr dd dt li".split()) | {"li", "dd", "dt"}
ENDS = {"li": ("li", frozenset("ul ol menu".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"])), "option": ("option", frozenset(["select"]))}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what is not the article, wherever in a name they stand. Fixed values.
MARKS = frozenset("advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion promoted banner sidebar widget widgets menubar nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus cookie cookies consent gdpr newsletter subscribe subscription pagination pager toolbar masthead popup modal".split())
#: Words that have other uses too: they only mark names in which nothing but such words and words of layout stands.
LOOSE = frozenset("ad ads side rail menu reply replies respond discussion notice notices notification alert overlay signup login share sharing social related recommended recommendations skip hidden copyright disclaimer".split())
LAYOUT_WORDS = frozenset("area aside bar block body bottom box btn button buttons card cards center col column container content drawer entry footer global group header icon icons inner item items js left link links list main modal outer page panel post posts primary right row secondary section site slot story stories sub tools top unit view wide wrap wrapper zone".split())
NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: has-sidebar, content-with-comments, no-ads: such a name tells the layout of what holds the article.
LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no)(?:[-_]|(?=[A-Z]))\S*")
#: Marks of what readers write: it can be longer than the article.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
PARAGRAPHS, HEADINGS = frozenset("p blockquote pre".split()), frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLES = frozenset(["article", "main"])
CONTENT = ARTICLES | {"body", "html"}
BORDERS = frozenset("td th li article section div body".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "inner", "own", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "marks", "pure", "depth", "block", "border", "article")

    def __init__(self, tag: str, parent: Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped, self.children, self.marks, self.pure = tag, parent, dropped, [], frozenset(), False
        # the nearest nodes from here up: a block, one that no inline end tag crosses; and whether an article is among them
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if tag in BLOCK or not parent else parent.block
        self.border = self if tag in BORDERS or not parent else parent.border
        self.article = tag in ARTICLES or bool(parent and parent.article)


def _marked(tag: str, attributes: str, inside_content: bool) -> tuple[bool, frozenset, bool]:
    """Whether an element is never content, and else the words that mark it as such, and whether its names that hold
    them hold nothing but such words and words of layout."""
    none = frozenset()
    if tag in DROPPED or tag == "header" and not inside_content:
        return True, none, True
    if not attributes or attributes == "/":
        return False, none, True
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True, none, True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True, none, True
    if tag in CONTENT:
        return False, none, True
    marks, pure = set(), True
    for name in LAYOUT.sub("", f"{found.get('class', '')} {found.get('id', '')}").split():
        parts = {x.lower() for x in NAME_PARTS.split(name) if x and not x.isdigit()}
        marks |= MARKS & parts
        if parts <= LOOSE | MARKS | LAYOUT_WORDS:
            marks |= LOOSE & parts
        elif MARKS & parts:
            pure = False
        # a block named header holds the site's name, unless it is part of the article
        if "header" in parts and not inside_content and tag in ("div", "section"):
            marks.add("header")
    return False, frozenset(marks), pure


class _Marked:
    """Drops the elements that their names mark, but not those that hold the article in spite of them.

    Elements of one set of marks are judged together, those inside an article or main apart from the others. They stay
    if they hold more characters outside links than what is known to stay: the unmarked text, to which the larger sets
    are added first. So an article in many blocks of one name stays, and smaller sets beside it go. Outside of
    articles none stays if there is one; an element that holds an article or main itself is judged by itself. In an
    article, parts that only their looser names mark stay if they have paragraphs like it, and parts whose names hold
    other words too stay if they have one. What readers write stays only if nothing else but headings is there.
    """

    def __init__(self, root: Node):
        self.plain: dict[Node, int] = {}
        self.linked: dict[Node, int] = {}
        self.paragraphs: dict[Node, int] = {}
        self.holds: dict[Node, bool] = {}
        for n in reversed(_walk(root)):
            below = [x for x in n.children if isinstance(x, Node) and not x.dropped]
            text = sum(_length(x) for x in n.children if isinstance(x, str)) + sum(self.plain[x] for x in below)
            self.plain[n] = 0 if n.tag == "a" else text
            self.linked[n] = (text if n.tag == "a" else 0) + sum(self.linked[x] for x in below)
            self.paragraphs[n] = sum(self.paragraphs[x] for x in below) + (n.tag in PARAGRAPHS and self.plain[n] > self.linked[n])
            self.holds[n] = any(self.holds[x] or x.tag in ARTICLES and self.plain[x] > 0 for x in below)
        # what stays for sure: characters of the page, those of its articles, and those that are no headings
        self.page = self.articles = self.prose = 0
        opened = [root]
        while opened:
            opened = self.judged(self.look(opened))

    def look(self, opened: list[Node]) -> list[Node]:
        """Counts the text of opened elements up to marked ones, which it returns."""
        marked, todo = [], [(n, n.article, n.tag in HEADINGS) for n in opened]
        while todo:
            n, inside, heading = todo.pop()
            if n.tag == "a":
                continue
            own = sum(_length(x) for x in n.children if isinstance(x, str))
            self.page, self.articles, self.prose = self.page + own, self.articles + own * inside, self.prose + own * (not heading)
            for x in n.children:
                if isinstance(x, Node) and not x.dropped:
                    if x.marks:
                        marked.append(x)
                    else:
                        todo.append((x, inside or x.article, heading or x.tag in HEADINGS))
        return marked

    def judged(self, marked: list[Node]) -> list[Node]:
        """Those of the marked elements that stay; the others are dropped."""
        groups: dict[object, list[Node]] = {}
        for n in marked:
            # an element around an article is a group of its own
            groups.setdefault(n if self.holds[n] else (n.marks, n.article), []).append(n)
        size = {key: sum(self.plain[n] for n in group) for key, group in groups.items()}
        kept, page, articles = [], self.page, self.articles
        readers = lambda group: bool(group[0].marks & READERS)
        for key in sorted(groups, key=lambda k: (readers(groups[k]), -size[k])):
            group, inside = groups[key], groups[key][0].article
            if readers(group):
                stays = not articles if isinstance(key, Node) else not self.prose and not kept
            elif isinstance(key, Node):
                stays = size[key] > articles
            else:
                stays = size[key] > articles if inside else not articles and size[key] > page
            if stays and size[key]:
                kept += group
                page, articles = page + size[key], articles + size[key] * (inside or isinstance(key, Node))
            elif inside and not readers(group):
                kept += [n for n in group if self.is_part(n)]
        whole = set(kept)
        for n in marked:
            n.dropped = n not in whole
        return kept

    def is_part(self, n: Node) -> bool:
        """Is a marked part of an article prose all the same?"""
        least = 1 if not n.pure else 2 if n.marks <= LOOSE else None
        return least is not None and self.plain[n] > self.linked[n] and self.paragraphs[n] >= least


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose attributes begin at a place; a quote that is never closed is a character like others."""
    while (at := PLAIN.match(html, at).end()) < len(html) and html[at] != ">":
        at = max(at, html.find(html[at], at + 1)) + 1
    return at


class _Open:
    """The open elements, by tag too, so that none is looked for along the whole way up."""

    def __init__(self) -> None:
        self.root = self.node = Node("#root", None, False)
        self.by_tag: dict[str, list[Node]] = {}

    def add(self, new: Node) -> None:
        self.by_tag.setdefault(new.tag, []).append(new)
        self.node = new

    def close(self, last: Node) -> None:
        """Closes all elements down from last."""
        while self.node is not last.parent:
            self.by_tag[self.node.tag].pop()
            self.node = self.node.parent

    def nearest(self, tags: Iterable[str]) -> Node:
        return max((x[-1] for t in tags if (x := self.by_tag.get(t))), key=lambda n: n.depth, default=self.root)

    def end(self, tag: str) -> bool:
        """Closes the nearest element of a tag; false if there is none. An inline one closes nothing beyond its block."""
        last = self.nearest([tag])
        if last is self.root or tag not in BLOCK and self.node.border.depth > last.depth:
            return False
        self.close(last)
        return True

    def before(self, tag: str) -> None:
        """Closes what the start of an element ends."""
        if tag in ENDS_P and self.node.block.tag == "p":
            self.close(self.node.block)
        if tag == "body" and self.node.tag == "head":
            self.close(self.node)
        if tag in ENDS:
            kinds, holders = ENDS[tag]
            border, last = self.nearest(holders).depth, None
            for kind in kinds.split():
                for n in reversed(self.by_tag.get(kind, ())):
                    if n.depth <= border:
                        break
                    last = n if last is None or n.depth < last.depth else last
            if last is not None:
                self.close(last)


def parse(html: str) -> Node:
    """The tree below a root; texts are strings among the children. Open tags at the end are closed there.

    What stands behind the end tag of the body is part of it. Time is linear in the page's length.
    """
    open_, at, end, marked = _Open(), 0, len(html), False
    while at < end:
        m = TOKEN.search(html, at)
        if m is None or m.start() > at:
            stop = m.start() if m else end
            if not open_.node.dropped:
                open_.node.children.append(unescape(html[at:stop]))
            if m is None:
                break
        at = m.end()
        if m[1] is not None and not open_.node.dropped:
            open_.node.children.append(m[1])
        tag = (m[3] or "").lower()
        if not tag:
            continue
        stop = _tag_end(html, at)
        attributes, at = html[at:stop], stop + 1
        if m[2]:
            if tag not in ("body", "html") and not open_.end(tag) and tag == "p" and not open_.node.dropped:
                open_.node.children.append(Node("p", open_.node, False))
            continue
        if tag in ("html", "body") and open_.by_tag.get(tag):
            continue
        open_.before(tag)
        node = open_.node
        never, marks, pure = (True, frozenset(), True) if node.dropped else _marked(tag, attributes, node.article)
        new = Node(tag, node, never)
        new.marks, new.pure = marks, pure
        marked = marked or bool(marks)
        node.children.append(new)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        open_.add(new)
    if marked:
        _Marked(open_.root)
    return open_.root


def _line(node: Node) -> Iterator[Node]:
    while node is not None and node.tag != "#root":
        yield node
        node = node.parent


def _walk(root: Node) -> list[Node]:
    """Nodes in page order; reversed, children come before their parents."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.children) if isinstance(x, Node) and not x.dropped]
    return out


def _length(x: str) -> int:
    words = x.split()
    return sum(map(len, words)) + len(words) - 1 if words else 0


def _density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    if not c:
        return 0.0
    t, plain = max(t, 1), max(c - lc, 1)
    base = math.log(c / plain * lc + body_lc / max(body_c, 1) * c + math.e)
    value = (c / max(lc, 1)) * (t / max(lt, 1))
    return c / t * math.log(max(value, 1.0) + 1e-12) / base if value > 1 else 0.0


def content_nodes(root: Node) -> list[Node]:
    """The content's nodes in page order."""
    order = _walk(root)
    body = next((n for n in order if n.tag == "body"), root)
    for n in reversed(order):
        below = [x for x in n.children if isinstance(x, Node) and not x.dropped]
        n.inner = below
        n.own = sum(_length(x) for x in n.children if isinstance(x, str))
        n.chars = n.own + sum(x.chars for x in below)
        n.tags = len(below) + sum(x.tags for x in below)
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(x.link_chars for x in below)
        n.link_tags = sum(x.link_tags + (x.tag == "a") for x in below)
    for n in reversed(order):
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, body.chars, body.link_chars)
        # text that stands in a node itself counts as one child of one tag
        n.total = sum(x.density for x in n.inner) + (_density(n.own, 1, n.own if n.tag == "a" else 0, 0, body.chars, body.link_chars) if n.own else 0.0)
        n.best = max([n, *(x.best for x in n.inner)], key=lambda x: x.total)
    top = body.best
    while top is not body and top.parent is not body and not any(x.tag in BLOCK for x in top.inner):
        top = top.parent  # a paragraph by itself is no article: what holds it is
    threshold = top.density
    for n in _line(top):
        threshold = min(threshold, n.density)
        if n is body:
            break
    path = set()
    for n in _line(top):
        path.add(n)
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        on_path = n in path
        if n is top or not on_path and n.best is n:
            out.append(n)
            continue
        # beside the way to the best node, a child counts by itself if it is at or above the threshold
        todo += [x for x in reversed(n.inner) if (x in path if on_path else x.best is n.best) or x.density >= threshold and x.chars]
    return out


def _menu(n: Node) -> bool:
    """A list or block outside the article that is all links; inside it is a list of references."""
    return not n.article and n.link_tags >= 2 and n.link_chars >= 0.9 * n.chars and n.tag in BLOCK


def blocks(nodes: list[Node]) -> Iterator[str]:
    """The texts between block borders, each with single spaces."""
    now: list[str] = []
    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                now.append(x)
            elif x is None:
                yield "".join(now)
                now = []
            elif x.tag == "br":
                now.append(" ")
            elif not x.dropped and not _menu(x):
                border = [None] if x.tag in BLOCK else []
                todo += [*border, *reversed(x.children), *border]
        yield "".join(now)
        now = []


def main_text(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    parts = (" ".join(x.split()) for x in blocks(content_nodes(parse(html))))
    return "\n".join(x for x in parts if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row of pages.

    text is the page's main text, from the whole page; n_chars its code points. Null and empty pages, and pages with
    nothing but menus, notices and the like, have an empty text. Pages without tags are all text. Repeated rows are
    each returned; an empty table gives an empty table. Other columns are not read.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    found = rows.mapInArrow(make, T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
