"""Listings of documents from recorded JSON pages, in one shape: (document_id, code, name, title, published_at,
document_url, attachment, description)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import dates as D
from ..functions import text as X
from .feeds import feed_rows

# Shapes, hosts and kinds of the pages.
STATIC, EXCHANGE = "https://static.cninfo.com.cn/", "https://www.bse.cn/"
SHAPES = {
    "irm_ircs": ("totalRecord string, results array<struct<indexId string, esId string, mainContent string, stockCode string, companyShortName string, pubDate string, attachmentUrl string, filetype string>>", "results"),
    "bse_announcement": ("data struct<content array<struct<totalElements string, disclosures array<struct<disclosureCode string, disclosureTitle string, disclosurePostTitle string, publishDate string, companyCd string, companyName string, destFilePath string, fileExt string, disclosureType string, disclosureSubType string>>>>>", "data.content"),
    "bse_performance": ("listInfo struct<totalElements string, content array<struct<id string, title string, stockCode string, stockName string, showDate struct<time: string>, beginTime string, endTime string, type string, url1 string, uploadReport string>>>", "listInfo.content"),
}


def _text(name: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(name), F.lit(""))), F.lit(""))


def _listed(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    return rows.select(*keep, *(c.alias(n) for n, c in columns.items()))


def _below(base: str, path: Column) -> Column:
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), path).otherwise(F.concat(F.lit(base), F.ltrim(path, F.lit("/"))))


def irm_ircs(pages: DataFrame, column: str) -> DataFrame:
    """Records of investor relations: items without an id, title, code or time are left out."""
    keep = [c for c in pages.columns if c != column]
    rows = feed_rows(pages, column, *SHAPES["irm_ircs"])
    ms, index = F.col("pubDate").try_cast("long"), F.coalesce(_text("indexId"), _text("esId"))
    rows = rows.where(index.isNotNull() & _text("mainContent").isNotNull() & _text("stockCode").isNotNull() & (ms > 0))
    code = _text("stockCode")
    return _listed(rows, keep, document_id=F.concat(F.lit("irm_ircs:"), index), code=F.when(X.is_share_code(code), code), name=F.coalesce(_text("companyShortName"), code), title=_text("mainContent"), published_at=D.from_epoch_ms(ms), document_url=_below(STATIC, _text("attachmentUrl")), attachment=F.upper(_text("filetype")), description=_text("mainContent"))


def bse_announcements(pages: DataFrame, column: str) -> DataFrame:
    """Announcements in JSONP pages, wrapped by market. A page with an item that lacks its code, title or day fails, as
    its total could then not be reconciled."""
    keep = [c for c in pages.columns if c != column]
    wrappers = feed_rows(pages, column, *SHAPES["bse_announcement"], jsonp=True)
    known = F.col("disclosures").isNotNull() & F.col("totalElements").try_cast("double").isNotNull()
    rows = wrappers.where(F.assert_true(known, F.lit("a market has no list or total")).isNull()).select(*keep, F.inline("disclosures"))
    title, day = F.concat(F.coalesce(_text("disclosureTitle"), F.lit("")), F.coalesce(_text("disclosurePostTitle"), F.lit(""))), _text("publishDate").try_cast("date")
    whole = _text("disclosureCode").isNotNull() & (title != "") & F.coalesce(_text("publishDate"), F.lit("")).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & day.isNotNull()
    rows = rows.where(F.assert_true(whole, F.lit("an announcement lacks its code, title or day")).isNull())
    url = _below(EXCHANGE, _text("destFilePath"))
    ending = F.when(url.rlike(r"\.[^.]*$"), F.upper(F.regexp_extract(url, r"\.([^.]*)$", 1)))
    return _listed(rows, keep, document_id=F.concat(F.lit("bse_ann:"), _text("disclosureCode")), code=_text("companyCd"), name=_text("companyName"), title=title, published_at=day.cast("timestamp_ntz"), document_url=url, attachment=F.coalesce(F.upper(_text("fileExt")), ending), description=F.concat_ws("/", _text("disclosureType"), _text("disclosureSubType")))


def bse_total(pages: DataFrame, column: str) -> DataFrame:
    """pages without the column, with the total that their markets state."""
    keep = [c for c in pages.columns if c != column]
    wrappers = feed_rows(pages, column, *SHAPES["bse_announcement"], jsonp=True)
    return wrappers.groupBy(*keep).agg(F.sum(F.col("totalElements").cast("double").cast("long")).alias("total"))


def bse_performances(pages: DataFrame, column: str) -> DataFrame:
    """Briefings in JSONP pages, each a list of one: items without an id, title or time are left out. The report stands
    for the document, else the broadcast."""
    keep = [c for c in pages.columns if c != column]
    inner = pages.withColumn(column, F.regexp_replace(X.jsonp_body(F.col(column)), r"(?s)^\s*\[(.*)\]\s*$", "$1"))
    rows = feed_rows(inner, column, *SHAPES["bse_performance"])
    ms, report, stream = F.col("showDate.time").try_cast("long"), _text("uploadReport"), _text("url1")
    rows = rows.where(_text("id").isNotNull() & _text("title").isNotNull() & (ms > 0))
    ending = F.upper(F.regexp_extract(report, r"(?i)\.(pdf|docx?)$", 1))
    span = F.when(_text("beginTime").isNotNull() & _text("endTime").isNotNull(), F.concat_ws("-", _text("beginTime"), _text("endTime")))
    return _listed(rows, keep, document_id=F.concat(F.lit("bse_perf:"), _text("id")), code=_text("stockCode"), name=_text("stockName"), title=_text("title"), published_at=D.from_epoch_ms(ms), document_url=F.coalesce(report, stream), attachment=F.nullif(ending, F.lit("")), description=F.concat_ws(" ", _text("type"), span, F.concat(F.lit("直播："), stream)))
