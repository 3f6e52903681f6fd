"""Fields of article pages and of question feeds: bodies, stocks, tags, sources and times from their elements.

A page is parsed inside an Arrow batch into plain fields; what they mean (times, codes, raters) is decided by columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import dates as D
from ..functions import text as X

# Classes, patterns and defaults of the pages.
BODIES = (("news-content-parsed",), ("news-content", "article-content"), ("article-content",), ("main-text",), ("art_main",))
STOCK_URL = re.compile(r"stockpage\.10jqka\.com\.cn/(\d{6})(?:/|\b)", re.I)
CONCEPT_HOST, CONCEPT = "q.10jqka.com.cn", re.compile(r"(?<!\d)(8[58]\d{4})(?!\d)")
EMBEDDED_PAIR = re.compile(r'(?:stockName|name)\\?"\s*:\s*\\?"([^"\\]{1,30})\\?".{0,180}?(?:stockCode|code)\\?"\s*:\s*\\?"(\d{6})\\?"', re.S)
EMBEDDED_CODE = re.compile(r'data-code=\\?"(\d{6})\\?"')
BYLINE, OWN_SOURCE = "金融研究中心", "同花顺财经"
SOURCE = re.compile(r"来源[：:]\s*([^\s|]{1,40})")
SOURCE_IN_HTML = (re.compile(r'"media"\s*:\s*\{[^{}]{0,200}?"name"\s*:\s*"([^"]+)"'), re.compile(r"来源[：:]\s*</?[^>]*>?\s*([^<\s]{1,40})"))
MOMENT = r"(20\d{2})[-/年](\d{1,2})[-/月](\d{1,2})日?\s*(\d{1,2}):(\d{2})(?::(\d{2}))?"
MARKS, SHARE = " ：:，,[]【】", re.compile(r"6\d{5}|(?:00[0-3]|30[01]|920)\d{3}")
MENTION = r":([一-龥A-Za-z0-9]+)\((\d{6})\)"
AVATAR = r"(?i)/company/(\d{6})\.(?:png|jpg|jpeg|gif)"
QUESTION_URL, UNTITLED, MOST_TITLE = "https://sns.sseinfo.com/ajax/feeds.do?id=", "上市公司发布", 200
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Tags whose content isn't markup, and a tag or text that a page of plain markup consists of.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
PLAIN = re.compile(r'<(/?)([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z-]*="[^"<>&]*")*)>|([^<&]+)')
ATTRIBUTE = re.compile(r'([a-z][a-z-]*)="([^"]*)"')


class Element:
    """An element of a page: children are elements and texts. All elements of a page are in one list, in order; an
    element's own stand behind it, up to its end."""

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.classes = frozenset(attributes["class"].split()) if "class" in attributes else frozenset()
        self.page = parent.page if parent else []
        self.page.append(self)
        self.place, self.end = len(self.page), None

    def all(self) -> Iterator[Element]:
        return iter(self.page[self.place : self.end])

    def first(self, test: Callable[[Element], bool]) -> Element | None:
        return next((x for x in self.all() if test(x)), None)

    def inside(self, *classes: str) -> Element | None:
        """The first element of a chain of classes, each inside the one before."""
        now = iter((self,))
        for c in classes:
            now = _within(now, c, _classes(c))
        return next(now, None)

    def texts(self) -> Iterator[str]:
        for x in self.children:
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                yield from x.texts()

    def text(self) -> str:
        return " ".join(x.strip() for x in self.texts() if x.strip())


def _within(around: Iterator[Element], tag: str, classes: frozenset) -> Iterator[Element]:
    return (x for n in around for x in n.all() if classes <= x.classes or x.tag == tag)


@lru_cache(256)
def _classes(dotted: str) -> frozenset:
    return frozenset(dotted.split("."))


class _Tree:
    """Elements as their tags come."""

    def __init__(self):
        self.root = self.now = Element("", {}, None)

    def opened(self, tag: str, attributes: dict[str, str], closed: bool) -> None:
        new = Element(tag, attributes, self.now)
        self.now.children.append(new)
        if closed:
            new.end = new.place
        else:
            self.now = new

    def closed(self, tag: str) -> None:
        node = self.now
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            end, x = len(node.page), self.now
            while x is not node.parent:
                x.end, x = end, x.parent
            self.now = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree = _Tree()

    def handle_starttag(self, tag, attrs):
        self.tree.opened(tag, {k: v or "" for k, v in attrs}, tag in VOID)

    def handle_startendtag(self, tag, attrs):
        self.tree.opened(tag, {k: v or "" for k, v in attrs}, True)

    def handle_endtag(self, tag):
        self.tree.closed(tag)

    def handle_data(self, data):
        self.tree.now.children.append(data)


def _plain_page(html: str) -> Element | None:
    """The page, if it holds nothing but plain tags and texts, which one expression tells apart; else null."""
    tree, at = _Tree(), 0
    while at < len(html):
        m = PLAIN.match(html, at)
        if m is None:
            return None
        at, (end, tag, attributes, text) = m.end(), m.groups()
        if text:
            tree.now.children.append(text)
        elif end and not attributes:
            tree.closed(tag)
        elif end or tag in RAW:
            return None
        else:
            tree.opened(tag, dict(ATTRIBUTE.findall(attributes)) if attributes else {}, tag in VOID)
    return tree.root


def _parsed_page(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.tree.root


def page(html: str) -> Element:
    return _plain_page(html) or _parsed_page(html)


def body_of(root: Element) -> Element:
    """The element that holds the article, by class in order of trust; the page if there is none."""
    for classes in BODIES:
        found = root.first(lambda x, classes=classes: set(classes) <= x.classes)
        if found:
            return found
    return root.first(lambda x: x.attributes.get("id") == "content") or root.first(lambda x: x.tag == "article") or root


def _name(text: str, code: str) -> str:
    bare = re.sub(r"[（(]\s*" + re.escape(code) + r"\s*[)）]", "", unescape(text))
    return re.sub(r"\s+", " ", bare).strip(MARKS)[:40] or code


def _byline(anchor: Element) -> bool:
    """Does a link name the newsroom? What follows it, or an element around it, then says so."""
    node = anchor
    for _ in range(4):
        if node is None or node.parent is None:
            return False
        around = node.parent.children
        behind = around[next(i for i, x in enumerate(around) if x is node) + 1 :]
        if behind:
            return (behind[0] if isinstance(behind[0], str) else behind[0].text()).strip().startswith(BYLINE)
        node = node.parent
    return False


def _links(body: Element) -> Iterator[tuple[Element, str, str]]:
    for a in body.all():
        if a.tag == "a":
            yield a, a.attributes.get("href", ""), a.attributes.get("data-code", "").strip()


def _stocks(body: Element) -> dict[str, str]:
    found: dict[str, str] = {}
    for a, href, code in _links(body):
        if not code and (m := STOCK_URL.search(href)):
            code = m[1]
        if a.attributes.get("data-type", "stock").lower() in ("", "stock") and SHARE.fullmatch(code) and not _byline(a):
            found.setdefault(code, _name(a.text(), code))
    return found


def _embedded(html: str) -> dict[str, str]:
    plain = html.replace("\\u003c", "<").replace("\\u003e", ">").replace('\\"', '"')
    found = _stocks(body_of(page(plain)))
    for m in EMBEDDED_PAIR.finditer(html):
        if SHARE.fullmatch(m[2]):
            found.setdefault(m[2], _name(m[1], m[2]))
    return found or {c: c for c in EMBEDDED_CODE.findall(html) if SHARE.fullmatch(c)}


def _source(root: Element, html: str) -> str:
    holder = root.first(lambda x: any(isinstance(c, str) and re.search("来源[：:]", c) for c in x.children))
    if holder and (m := SOURCE.search(holder.text())):
        return m[1].strip()
    return next((unescape(m[1]).strip() for p in SOURCE_IN_HTML if (m := p.search(html))), OWN_SOURCE)


def _said(root: Element, html: str) -> str | None:
    """The text that states the time: of time elements first, else of the page."""
    tests = (lambda x: x.tag == "time", lambda x: "time" in x.classes, lambda x: "publish-time" in x.classes, lambda x: "time" in x.attributes.get("class", ""))
    nodes = [n.text() for t in tests if (n := root.first(t))]
    return next((m[0] for x in [*nodes, html] if (m := re.search(MOMENT, x))), None)


def article(html: str | None) -> dict:
    html = html or ""
    root = page(html)
    body = body_of(root)
    stocks = _stocks(body) or _embedded(html)
    tags, concepts = [], []
    for a, href, code in _links(body):
        kind, text = a.attributes.get("data-type", "").strip().lower(), a.text()
        if "industry" in kind or kind == "hy":
            tags.append(_name(text, code) if code else re.sub(r"\s+", " ", text).strip(MARKS))
        if (code or CONCEPT_HOST in href) and (m := CONCEPT.search(f"{code} {href} {text}")):
            concepts.append(re.sub(r"[（(]?\s*" + m[1] + r"\s*[）)]?", "", text).strip(MARKS))
    unique = lambda xs: [x for x in dict.fromkeys(xs) if x]
    return {"body": body.text(), "stocks": [{"code": c, "name": stocks[c]} for c in sorted(stocks)], "tags": unique(tags), "concepts": unique(concepts), "source": _source(root, html), "said": _said(root, html)}


ARTICLE = "struct<body: string, stocks: array<struct<code: string, name: string>>, tags: array<string>, concepts: array<string>, source: string, said: string>"
ITEM = "array<struct<item: string, question: string, asked: string, reply: string, replied: string, text: string, link: string, link_text: string, name: string, avatar: string, said: string>>"


def moment(said: Column) -> Column:
    """A time stated in full, with or without seconds; null if it is none."""
    part = lambda i: F.regexp_extract(said, MOMENT, i)
    text = F.format_string("%s-%02d-%02d %02d:%s:%s", part(1), part(2).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("int"), part(5), F.coalesce(F.nullif(part(6), F.lit("")), F.lit("00")))
    return F.when(part(1) != "", text).try_cast("timestamp_ntz")


def articles(pages: DataFrame, html: str, title: Column, summary: Column, listed_at: Column) -> DataFrame:
    """pages with body, stocks, tags, concepts, source and published_at of each article page.

    stocks are in order of code, without newsroom bylines and brokers that are named as raters. published_at is the
    page's own time, else that of the list it was found in. Null and empty pages have empty fields.
    """

    @F.pandas_udf(ARTICLE)
    def fields(htmls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(h) for h in htmls], columns=["body", "stocks", "tags", "concepts", "source", "said"])

    read = pages.withColumn("__a", fields(F.col(html)))
    a = lambda c: F.col(f"__a.{c}")
    named = X.without_raters(a("stocks"), title, summary, a("body"))
    return read.withColumns({"body": a("body"), "stocks": named, "tags": a("tags"), "concepts": a("concepts"), "source": a("source"), "published_at": F.coalesce(moment(a("said")), listed_at)}).drop("__a")


def feed_items(html: str | None) -> list[dict]:
    """The items of a feed page in order, each once."""
    out, seen = [], set()
    for node in page(html or "").all():
        if "m_feed_item" not in node.classes:
            continue
        item = next((v[5:] for k in ("id", "data-id") if (v := node.attributes.get(k, "").strip()).startswith("item-")), "")
        if not item or item in seen:
            continue
        seen.add(item)
        text = lambda *way, node=node: n.text() if (n := node.inside(*way)) else None
        said = node.inside("m_feed_txt")
        link = said and said.first(lambda x: x.tag == "a" and "href" in x.attributes)
        face = node.inside("m_feed_face")
        image = face and face.inside("img")
        out.append({
            "item": item, "question": text("m_feed_detail.m_qa_detail", "m_feed_txt") or text("m_feed_txt"), "asked": text("m_feed_detail.m_qa_detail", "m_feed_from", "span") or text("m_feed_from", "span"),
            "reply": text("m_feed_detail.m_qa", "m_feed_txt") or None, "replied": text("m_feed_detail.m_qa", "m_feed_from", "span"), "text": said.text() if said else None,
            "link": link.attributes["href"].strip() if link else None, "link_text": link.text() if link else None, "name": n.text() if face and (n := face.inside("p")) else None, "avatar": image.attributes.get("src", "") if image else None, "said": text("m_feed_from", "span"),
        })
    return out


def _items(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    @F.pandas_udf(ITEM)
    def items(htmls: pd.Series) -> pd.Series:
        return htmls.map(feed_items)

    return pages.select(*keep, F.inline(items(F.col(html))))


def question_feed(pages: DataFrame, html: str, now: str) -> DataFrame:
    """(record_id, code, name, question, asked_at, url, reply, replied_at) of questions that name a listed share and say
    when they were asked. now is the column with the time a page was read."""
    rows = _items(pages, html, [now])
    code, name = F.regexp_extract("question", MENTION, 2), F.regexp_extract("question", MENTION, 1)
    asked, replied = D.relative_time(F.col("asked"), F.col(now)), D.relative_time(F.col("replied"), F.col(now))
    plain = F.regexp_replace(F.regexp_replace("question", MENTION, ""), "^[ :：]+|[ :：]+$", "")
    out = rows.where(X.is_share_code(code)).select(F.concat(F.lit("sse:"), "item").alias("record_id"), code.alias("code"), name.alias("name"), plain.alias("question"), asked.alias("asked_at"), F.concat(F.lit(QUESTION_URL), "item").alias("url"), "reply", replied.alias("replied_at"))
    return out.where("asked_at is not null")


def published_feed(pages: DataFrame, html: str, now: str) -> DataFrame:
    """(document_id, code, name, title, published_at, document_url, attachment, description) of what companies publish:
    the title is the attached file's name without its ending, else the text."""
    rows = _items(pages, html, [now]).where("text is not null")
    code = F.regexp_extract(F.coalesce("avatar", F.lit("")), AVATAR, 1)
    url = F.when(F.col("link").rlike("^https?://"), F.col("link"))
    ending = F.upper(F.nullif(F.regexp_extract(F.coalesce(url, "link_text", F.lit("")), r"\.([A-Za-z0-9]+)$", 1), F.lit("")))
    file = F.nullif(F.trim(F.regexp_replace(F.coalesce("link_text", F.lit("")), r"(?i)\.(docx?|pdf|xlsx?|txt)$", "")), F.lit(""))
    plain = F.nullif(F.substring(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), "^[ ：:，,。]+|[ ：:，,。]+$", ""), 1, MOST_TITLE), F.lit(""))
    out = rows.select(
        F.concat(F.lit("ssepub:"), "item").alias("document_id"), F.when(X.is_share_code(code), code).alias("code"), F.when(X.is_share_code(code), F.nullif(F.trim("name"), F.lit(""))).alias("name"), F.coalesce(file, plain, F.lit(UNTITLED)).alias("title"),
        D.relative_time(F.col("said"), F.col(now)).alias("published_at"), url.alias("document_url"), F.when(F.col("link").isNotNull(), ending).alias("attachment"), F.col("text").alias("description"),
    )
    return out.where("published_at is not null")
