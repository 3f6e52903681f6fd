"""Feeds, attachments, boards and versions."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, sinks


def test_feed_rows_skip_or_fail(spark):
    shape, at = feeds.SHAPES["eastmoney_industry"]
    page = '{"result":{"data":[{"SECURITY_CODE":"600000","EM2016":"金融-银行"},{"EM2016":"x"}]}}'
    df = spark.createDataFrame([("p1", page)], "id string, body string")
    rows = feeds.feed_rows(df, "body", shape, at, required=("SECURITY_CODE",)).withColumn("industry", feeds.industry_label(F.col("EM2016"))).collect()
    assert [(r.id, r.SECURITY_CODE, r.industry) for r in rows] == [("p1", "600000", "金融")]
    with pytest.raises(Exception, match="lacks"):
        feeds.feed_rows(df, "body", shape, at, required=("SECURITY_CODE",), strict=True).collect()
    with pytest.raises(Exception):  # noqa: B017  a page of another shape fails
        feeds.feed_rows(spark.createDataFrame([("p", "<html>login</html>")], "id string, body string"), "body", shape, at).collect()
    with pytest.raises(Exception, match="no list"):
        feeds.feed_rows(spark.createDataFrame([("p", '{"result":null}')], "id string, body string"), "body", shape, at).collect()


def test_jsonp_of_single_item_lists(spark):
    shape, at = feeds.SHAPES["sse_announcement"]
    page = 'cb({"pageHelp":{"total":2,"data":[[{"TITLE":"a","SECURITY_CODE":"1"}],[{"TITLE":"b(c)","SECURITY_CODE":"2"}]]}})'
    rows = feeds.feed_rows(spark.createDataFrame([(page,)], "body string"), "body", shape, at, jsonp=True).collect()
    assert [r.TITLE for r in rows] == ["a", "b(c)"]


def test_list_items_once_by_url(spark):
    html = '<ul><li><a class="n" data-seq="12" href="http://A.com//x?q=1">第一条</a> 2026-01-02 10:00</li><li><a href="http://A.com//x?q=1">again</a></li><li><a href="/c77.shtml">two &amp; three</a></li></ul>'
    rows = feeds.list_items(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").collect()
    assert [(r.seq, r.url, r.title, r.said) for r in rows] == [("12", "https://a.com/x", "第一条", "2026-01-02 10:00"), ("77", "/c77.shtml", "two & three", None)]


def test_decoding_and_attachments(spark):
    buf = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>段落</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    data = [(1, bytearray("<meta charset=gbk>公告".encode("gb18030"))), (2, bytearray("公告".encode())), (3, bytearray(buf.getvalue())), (4, bytearray(b"%PDF-1.4")), (5, None)]
    df = spark.createDataFrame(data, "id int, raw binary")
    text = {r.id: r.t for r in df.where("id in (1, 2, 5)").select("id", feeds.decoded("raw").alias("t")).collect()}
    assert text == {1: "<meta charset=gbk>公告", 2: "公告", 5: None}
    parsed = {r.id: (r.a.status, r.a.text) for r in df.where("id > 2").select("id", feeds.attachment_text("raw").alias("a")).collect()}
    assert parsed == {3: ("parsed", "段落\n甲 | 乙"), 4: ("failed", "pdf"), 5: ("empty_text", "")}


def test_repair_never_erases(spark):
    old = spark.createDataFrame([("1", 5.0, "a"), ("2", 6.0, None)], "code string, price double, name string")
    new = spark.createDataFrame([("1", 0.0, None), ("2", None, "b")], "code string, price double, name string")
    got = {r.code: (r.price, r.name) for r in feeds.repaired(old, new, "code", ["price", "name"]).collect()}
    assert got == {"1": (0.0, "a"), "2": (6.0, "b")}


def test_closed_days(spark):
    text = "2026年休市安排：春节：2月16日（星期一）至2月18日（星期三）休市，2月19日（星期四）起照常开市。2月14日（星期六）为周末休市。"
    days = {r.day for r in feeds.closed_days(spark.createDataFrame([(text,)], "t string"), "t").collect()}
    assert days == {date(2026, 2, 14), date(2026, 2, 16), date(2026, 2, 17), date(2026, 2, 18)}
    with pytest.raises(Exception, match="no year"):
        feeds.closed_days(spark.createDataFrame([("login",)], "t string"), "t").collect()


def test_csv_has_a_mark_and_order(spark, tmp_path):
    board = sinks.shown(spark.createDataFrame([(2, "乙", 1.5), (1, "甲", None)], "rank int, name string, heat double"), [("rank", "排名", ""), ("name", "名称", ""), ("heat", "热度", "%.2f")])
    sinks.write_csv(board, str(tmp_path / "b"), [F.col("排名")])
    text = next((tmp_path / "b").glob("*.csv")).read_text("utf-8")
    assert text.splitlines() == ["﻿排名,名称,热度", '1,甲,""', "2,乙,1.50"]


def test_versions_flip_together_and_none_keeps(spark, tmp_path):
    root = str(tmp_path / "boards")
    a, b = spark.range(2), spark.range(3)
    sinks.publish({"news": a, "qa": b}, root, 1)
    sinks.publish({"news": spark.range(5), "qa": None}, root, 2)
    assert sinks.current(spark, root) == {"news": 2, "qa": 1}
    assert sinks.read_current(spark, root, "news").count() == 5 and sinks.read_current(spark, root, "qa").count() == 3
    sinks.publish({"news": spark.range(0)}, root, 3)
    assert sinks.read_current(spark, root, "news").count() == 0
