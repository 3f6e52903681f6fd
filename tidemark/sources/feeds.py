"""Landed feeds to rows: JSON and JSONP with a declared schema, HTML lists, bytes and attachments."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from ..functions.text import canonical_url, jsonp_body, sequence_id

#: Shapes of the recorded feeds' rows. Fixed values.
SHAPES = {
    "cninfo": ("totalAnnouncement long, announcements array<struct<secCode string, secName string, announcementId string, announcementTitle string, announcementTime long, adjunctUrl string, adjunctType string>>", "announcements"),
    "irm": ("totalRecord long, results array<struct<indexId string, esId string, trade array<string>, mainContent string, stockCode string, companyShortName string, pubDate string, attachedContent string, attachedPubDate string>>", "results"),
    "sse_announcement": ("pageHelp struct<total long, data array<array<struct<ORG_BULLETIN_ID string, TITLE string, SECURITY_CODE string, SECURITY_NAME string, SSEDATE string, URL string, BULLETIN_TYPE_DESC string>>>>", "pageHelp.data"),
    "eastmoney_industry": ("result struct<data array<struct<SECURITY_CODE string, EM2016 string>>>", "result.data"),
}


def landed(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """Whole files: text in column value, or bytes in column content."""
    return spark.read.option("wholetext", True).text(path) if kind == "text" else spark.read.format("binaryFile").load(path)


def feed_rows(pages: DataFrame, column: str, shape: str, rows_at: str, jsonp: bool = False, required: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """One row for each item. Pages that aren't of the shape fail; rows without a required field are skipped, or with
    strict fail the page."""
    body = jsonp_body(F.col(column)) if jsonp else F.col(column)
    parsed = pages.withColumn("__p", F.from_json(body, shape, {"mode": "FAILFAST"}))
    items = F.col(f"__p.{rows_at}")
    kind = parsed.select(items.alias("x")).schema["x"].dataType
    if kind.elementType.typeName() == "array":
        items = F.flatten(items)
    checked = parsed.select(*pages.columns, F.when(items.isNull(), F.raise_error(F.lit("the page has no list of rows"))).otherwise(items).alias("__r"))
    rows = checked.select(*[c for c in pages.columns if c != column], F.inline("__r"))
    for c in required:
        rows = rows.where(F.assert_true(F.col(c).isNotNull(), F.lit(f"a row lacks {c}")).isNull()) if strict else rows.where(F.col(c).isNotNull())
    return rows


def industry_label(label: Column) -> Column:
    """The part before the first hyphen."""
    return F.split_part(label, F.lit("-"), F.lit(1))


def repaired(quotes: DataFrame, newer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Quotes with the newer values where there are any: a missing one never erases an older one, and 0 is a value."""
    after = newer.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    return quotes.join(after, key, "left").select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


_ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([\w-]+)\s*=\s*[\"']([^\"']*)[\"']")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2})?|\d{1,2}月\d{1,2}日 \d{1,2}:\d{2}")


def _strip(html: str) -> str:
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", html)).split())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("seq", "url", "title", "said")])))
def anchors(pages: pd.Series) -> pd.Series:
    """Links of a page in order, each once by its URL, with data-seq, title and the next time text near it."""

    def one(html: str | None) -> list[dict]:
        out, seen = [], set()
        for m in _ANCHOR.finditer(html or ""):
            at = dict(_ATTRIBUTE.findall(m[1]))
            url, title = at.get("href", ""), _strip(m[2])
            if url and title and url not in seen:
                seen.add(url)
                near = _TIME.search(_strip(html[m.end() : m.end() + 400]))
                out.append({"seq": at.get("data-seq"), "url": url, "title": title, "said": near[0] if near else None})
        return out

    return pages.map(one)


def list_items(pages: DataFrame, page_id: str, html: str, least_title: int = 0) -> DataFrame:
    """(page_id, seq, url, title, said) of the links of list pages; relative links stay as they are."""
    rows = pages.select(page_id, F.inline(anchors(F.col(html)))).where(F.length("title") >= least_title)
    absolute = F.col("url").rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    return rows.select(page_id, sequence_id(F.coalesce("seq", F.lit("")), F.col("url")).alias("seq"), F.when(absolute, canonical_url(F.col("url"))).otherwise(F.col("url")).alias("url"), "title", "said")


_META = re.compile(rb"charset=[\"']?([\w-]+)", re.I)


@F.pandas_udf(T.StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Text of bytes: by the page's own charset, then UTF-8, then GB 18030, at last with marks for what can't be read."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        said = _META.search(raw[:2048])
        names = [said[1].decode().lower()] if said else []
        for name in [*("gb18030" if n in ("gbk", "gb2312") else n for n in names), "utf-8", "gb18030"]:
            try:
                return raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
        return raw.decode("utf-8", "replace")

    return contents.map(one)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(raw: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    lines = []
    for block in root.iter():
        if block.tag == f"{_W}tr":
            lines.append(" | ".join("".join(t.text or "" for t in cell.iter(f"{_W}t")).strip() for cell in block.iter(f"{_W}tc")))
        elif block.tag == f"{_W}p" and not any(block in row.iter(f"{_W}p") for row in root.iter(f"{_W}tr")):
            lines.append("".join(t.text or "" for t in block.iter(f"{_W}t")))
    return "\n".join(x for x in lines if x.strip())


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("text", T.StringType())]))
def attachment_text(contents: pd.Series) -> pd.DataFrame:
    """status parsed, empty_text or failed, and the text of word-processing files; other kinds fail with their name."""

    def one(raw: bytes | None) -> tuple[str, str]:
        if not raw:
            return "empty_text", ""
        if raw[:4] != b"PK\x03\x04":
            return "failed", "pdf" if raw[:5] == b"%PDF-" else "unknown"
        try:
            text = _docx(bytes(raw))
        except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return "failed", "docx"
        return ("parsed", text) if text else ("empty_text", "")

    return pd.DataFrame([one(x) for x in contents], columns=["status", "text"])


def closed_days(pages: DataFrame, text: str) -> DataFrame:
    """(year, day) of the days a yearly schedule names: ranges up to 休市 and single days of 周末休市 sentences."""
    token = r"(\d{1,2})月(\d{1,2})日（星期[一二三四五六日天]）"
    year = F.regexp_extract(text, r"(20\d{2})年[^年]{0,20}休市", 1)
    day = lambda m, d: F.format_string("%s-%02d-%02d", F.col("year"), m.cast("int"), d.cast("int")).try_cast("date")
    rows = pages.select(year.alias("year"), F.col(text).alias("t"))
    rows = rows.where(F.assert_true(F.col("year") != "", F.lit("no year in the schedule")).isNull())
    spans = rows.select("year", F.explode(F.regexp_extract_all("t", F.lit(token + "至" + token + "休市"), F.lit(0))).alias("s"))
    part = lambda i: F.regexp_extract("s", token + "至" + token, i)
    ranged = spans.select("year", F.explode(F.sequence(day(part(1), part(2)), day(part(3), part(4)))).alias("day"))
    single = rows.select("year", F.explode(F.split("t", "[。；]")).alias("s")).where(F.col("s").rlike("(?:为|是).*周末休市")).select("year", F.explode(F.regexp_extract_all("s", F.lit(token), F.lit(0))).alias("s"))
    one = single.select("year", day(F.regexp_extract("s", token, 1), F.regexp_extract("s", token, 2)).alias("day"))
    return ranged.union(one).distinct()
