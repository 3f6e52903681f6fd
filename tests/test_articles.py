"""Article pages, question feeds and JSON listings."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import articles, listings

NOW = datetime(2026, 8, 5, 10)
PAGE = """<html><head><title>x</title></head><body><a data-code="600999">招商证券</a><div class="news-content article-content">
<p><a href="https://stockpage.10jqka.com.cn/300033/">同花顺（300033）</a>金融研究中心08月05日讯</p><p><b><a href="http://stockpage.10jqka.com.cn/300033">同花顺</a></b>金融研究中心</p>
<p>公司 <a data-code="600001" data-type="stock">甲股份(600001)</a> 与 <a href="//stockpage.10jqka.com.cn/000002/x">乙&amp;公司</a>，<a data-code="123456">不是</a>
<a data-type="hy" data-code="881101">种植业(881101)</a><a data-type="industry"> 【林业】 </a><a href="http://q.10jqka.com.cn/gn/detail/code/885525/">芯片概念（885525）</a></p></div>
<span>来源：证券时报 | 编辑</span><span class="publish-time">2026-08-05 09:30</span></body></html>"""


def test_article_fields():
    got = articles.article(PAGE)
    assert got["stocks"] == [{"code": "000002", "name": "乙&公司"}, {"code": "600001", "name": "甲股份"}]
    assert got["tags"] == ["种植业", "林业"] and got["concepts"] == ["种植业", "芯片概念"]
    assert got["source"] == "证券时报" and got["said"] == "2026-08-05 09:30" and "甲股份(600001)" in got["body"] and "招商" not in got["body"]


@pytest.mark.parametrize(("html", "stocks", "source"), [
    ('<p>x</p><script>{"stockName":"甲股份","x":1,"stockCode":"600001"}</script>', [("600001", "甲股份")], "同花顺财经"),
    ('<p>x</p><script>var c="\\u003ca data-code=\\"600002\\"\\u003e乙\\u003c/a\\u003e"</script>', [("600002", "600002")], "同花顺财经"),
    ('<p>x</p><!-- data-code="600003" --><script>{"media": {"id": 1, "name": "某报"}}</script>', [("600003", "600003")], "某报"),
    ("", [], "同花顺财经"), (None, [], "同花顺财经"),
])
def test_fields_of_odd_pages(html, stocks, source):
    got = articles.article(html)
    assert [(s["code"], s["name"]) for s in got["stocks"]] == stocks and got["source"] == source


def test_article_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "招商"), (2, None, None), (3, '<article><a data-code="600999">招商证券</a> 招商证券给予买入评级</article><time>2026年8月5日 9:30:15</time>', "t")], "id int, html string, title string")
    got = {r.id: r for r in articles.articles(df, "html", F.col("title"), F.lit(None).cast("string"), F.lit(NOW).cast("timestamp_ntz")).collect()}
    assert got[1].published_at == datetime(2026, 8, 5, 9, 30) and [s.code for s in got[1].stocks] == ["000002", "600001"]
    assert got[2].published_at == NOW and got[2].body == "" and got[2].stocks == []
    assert got[3].published_at == datetime(2026, 8, 5, 9, 30, 15)


FEED = """<div class="m_feed_item" id="item-1"><div class="m_feed_detail m_qa_detail"><div class="m_feed_txt">:<a>甲股份</a>(600001) 产能如何？</div><div class="m_feed_from"><span>2小时前</span></div></div>
<div class="m_feed_detail m_qa"><div class="m_feed_txt">很好。</div><div class="m_feed_from"><span>昨天 9:05</span></div></div></div>
<div class="m_feed_item" data-id="item-2"><div class="m_feed_txt">:乙股份(000002)何时分红</div><div class="m_feed_from"><span>刚刚</span></div></div>
<div class="m_feed_item" id="item-1"><div class="m_feed_txt">:乙股份(000002)again</div><div class="m_feed_from"><span>刚刚</span></div></div>
<div class="m_feed_item" id="item-3"><div class="m_feed_txt">:丙(123456)x</div><div class="m_feed_from"><span>刚刚</span></div></div>
<div class="m_feed_item" id="item-4"><div class="m_feed_txt">:丁股份(600004)x</div><div class="m_feed_from"><span>某时</span></div></div>"""


def test_question_feed(spark):
    df = spark.createDataFrame([(FEED.replace(":<a>甲股份</a>", ":甲股份"), NOW), (None, NOW), ("", NOW)], "html string, now timestamp_ntz")
    got = {r.record_id: r for r in articles.question_feed(df, "html", "now").collect()}
    assert set(got) == {"sse:1", "sse:2"}
    assert (got["sse:1"].code, got["sse:1"].name, got["sse:1"].question, got["sse:1"].reply) == ("600001", "甲股份", "产能如何？", "很好。")
    assert got["sse:1"].asked_at == datetime(2026, 8, 5, 8) and got["sse:1"].replied_at == datetime(2026, 8, 4, 9, 5)
    assert got["sse:2"].reply is None and got["sse:2"].asked_at == NOW


def test_published_feed(spark):
    html = """<div class="m_feed_item" id="item-7"><div class="m_feed_face"><img src="/company/600001.jpg"><p>甲股份</p></div><div class="m_feed_txt">见附件 <a href="https://x.cn/a/b.docx">调研记录.docx</a></div><div class="m_feed_from"><span>1天前</span></div></div>
    <div class="m_feed_item" id="item-8"><div class="m_feed_txt">：路演 公告。</div><div class="m_feed_from"><span>刚刚</span></div></div><div class="m_feed_item" id="item-9"><div class="m_feed_from"><span>刚刚</span></div></div>"""
    got = [tuple(r) for r in articles.published_feed(spark.createDataFrame([(html, NOW)], "html string, now timestamp_ntz"), "html", "now").orderBy("document_id").collect()]
    assert got[0] == ("ssepub:7", "600001", "甲股份", "调研记录", datetime(2026, 8, 4, 10), "https://x.cn/a/b.docx", "DOCX", "见附件 调研记录.docx")
    assert got[1] == ("ssepub:8", None, None, "路演 公告", NOW, None, None, "：路演 公告。") and len(got) == 2


def pages(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "page int, body string")


def test_irm_ircs(spark):
    item = {"indexId": "9", "mainContent": " 调研 ", "stockCode": "600001", "companyShortName": "甲", "pubDate": "1785888000000", "attachmentUrl": "/finalpage/a.PDF", "filetype": "pdf"}
    rows = listings.irm_ircs(pages(spark, json.dumps({"totalRecord": 5, "results": [item, item | {"indexId": "", "esId": "8", "stockCode": "830001", "attachmentUrl": "", "filetype": ""}, item | {"mainContent": ""}, item | {"pubDate": None}]})), "body").collect()
    assert [tuple(r)[1:] for r in rows] == [("irm_ircs:9", "600001", "甲", "调研", datetime(2026, 8, 5, 8), "https://static.cninfo.com.cn/finalpage/a.PDF", "PDF", "调研"), ("irm_ircs:8", None, "甲", "调研", datetime(2026, 8, 5, 8), None, None, "调研")]
    with pytest.raises(Exception, match="no list"):
        listings.irm_ircs(pages(spark, '{"other": 1}'), "body").collect()


def test_bse_announcements(spark):
    one = {"disclosureCode": "1", "disclosureTitle": "年报", "disclosurePostTitle": "摘要", "publishDate": "2026-08-05", "companyCd": "920001", "companyName": "北", "destFilePath": "/d/a.pdf", "fileExt": "", "disclosureType": "定期", "disclosureSubType": ""}
    page = lambda items: "cb(" + json.dumps({"data": {"content": [{"totalElements": "2", "disclosures": items}, {"totalElements": 3, "disclosures": []}]}}) + ")"
    df = pages(spark, page([one, one | {"disclosureCode": "2", "destFilePath": ""}]))
    got = [tuple(r)[1:] for r in listings.bse_announcements(df, "body").collect()]
    assert got == [("bse_ann:1", "920001", "北", "年报摘要", datetime(2026, 8, 5), "https://www.bse.cn/d/a.pdf", "PDF", "定期"), ("bse_ann:2", "920001", "北", "年报摘要", datetime(2026, 8, 5), None, None, "定期")]
    assert [r.total for r in listings.bse_total(df, "body").collect()] == [5]
    for bad in (one | {"publishDate": "soon"}, one | {"disclosureCode": None}):
        with pytest.raises(Exception, match="lacks its code"):
            listings.bse_announcements(pages(spark, page([bad])), "body").collect()


def test_bse_performances(spark):
    one = {"id": "3", "title": "说明会", "stockCode": "920002", "stockName": "京", "showDate": {"time": 1785888000000}, "beginTime": "9:00", "endTime": "10:00", "type": "业绩", "url1": "http://live", "uploadReport": "/r.DOCX"}
    body = "cb(" + json.dumps([{"listInfo": {"totalElements": 1, "content": [one, one | {"id": "4", "uploadReport": "", "beginTime": ""}, one | {"id": "5", "showDate": None}]}}]) + ")"
    got = [tuple(r)[1:] for r in listings.bse_performances(pages(spark, body), "body").collect()]
    assert got == [("bse_perf:3", "920002", "京", "说明会", datetime(2026, 8, 5, 8), "/r.DOCX", "DOCX", "业绩 9:00-10:00 直播：http://live"), ("bse_perf:4", "920002", "京", "说明会", datetime(2026, 8, 5, 8), "http://live", None, "业绩 直播：http://live")]
