"""Activity records, institution names and who counts."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import research as R

RECORD = """投资者关系活动记录表
活动时间：2026年5月6日
调研方式：现场调研
参与单位名称：约30家机构，南方基金、中金公司、华泰证券：王龙钰、DM Capital Limited
地点：公司会议室
问：公司产能利用率和订单情况如何？
答：产能利用率较高，2026年4月1日投产。
Q2：未来战略规划？
"""


@pytest.fixture(scope="module")
def record(spark):
    df = spark.createDataFrame([("r", RECORD, datetime(2026, 5, 8))], "id string, text string, published timestamp")
    return df.select("*", R.questions(F.col("text")).alias("q"), R.activity_kind(F.col("text")).alias("kind"), R.reported_count(F.col("text")).alias("n"), R.participants(F.col("text")).alias("people"))


def test_questions_have_depth_and_topic(record):
    q = record.first().q
    assert [(x.depth, x.topic) for x in q] == [("medium", "orders"), ("low", "growth")]


def test_kind_count_and_participants(record):
    r = record.first()
    assert r.kind == "survey" and r.n == 30
    assert set(r.people) >= {"南方基金", "中金公司", "华泰证券", "DM Capital Limited"} and not any("家机构" in p for p in r.people)


def test_only_labelled_lines_give_occurrences(record):
    out = R.occurrences(record, "id", "text", "published").collect()
    assert [(o.start, o.precision, o.eligible) for o in out] == [(date(2026, 5, 6), "explicit_day", True)]
    days = {r.day for r in R.activity_dates(record, "id", "text", "published").collect()}
    assert days == {date(2026, 5, 6), date(2026, 4, 1)}


def test_ranges_years_and_impossible_dates(spark):
    lines = ["2026年1月30日至2月2日", "12月30日", "2026年2月30日", "2026-03-01", "3月5日-7日", "none"]
    rows = spark.createDataFrame([(x, datetime(2026, 3, 10)) for x in lines], "line string, p timestamp").select("line", R.dates(F.col("line"), F.col("p")).alias("d")).collect()
    got = {r.line: [(d.start, d.end) for d in r.d] for r in rows}
    assert got["2026年1月30日至2月2日"] == [(date(2026, 1, 30), date(2026, 2, 2))]
    assert got["12月30日"] == [(date(2025, 12, 30), date(2025, 12, 30))]
    assert got["2026年2月30日"] == [] and got["none"] == []
    assert got["2026-03-01"] == [(date(2026, 3, 1), date(2026, 3, 1))]
    assert got["3月5日-7日"] == [(date(2026, 3, 5), date(2026, 3, 7))]


def test_a_range_stays_a_range_and_publication_is_the_last_resort(spark):
    df = spark.createDataFrame([("a", "会议时间：2026年3月1日至3月3日", datetime(2026, 3, 5)), ("b", "没有日期", datetime(2026, 3, 5)), ("c", "会议时间：2026年4月1日", datetime(2026, 3, 5))], "id string, text string, p timestamp")
    got = {r.id: r.precision for r in R.occurrences(df, "id", "text", "p").collect()}
    assert got == {"a": "explicit_range", "b": "disclosure_day", "c": "disclosure_day"}


def test_institution_names_and_types(spark):
    rows = [("中信证券股份有限公司", "中信证券", "brokerage"), ("ＡＢＣ（上海）资产管理有限公司", "abc上海资产管理", "asset_management"), ("南方基金", "南方基金", "public_fund"), ("平安银行", "平安银行", "other"), ("某某科技", "某某科技", "other")]
    out = spark.createDataFrame(rows, "raw string, alias string, kind string").select("*", R.normalize_institution(F.col("raw")).alias("a")).select("*", R.institution_type(F.col("a")).alias("k")).collect()
    assert all(r.a == r.alias and r.k == r.kind for r in out)


@pytest.mark.parametrize(("name", "kind", "context", "ok"), [("中信证券", "brokerage", "", True), ("平安银行", "other", "", False), ("平安银行", "other", "平安银行研究部", True), ("华能信托", "other", "证券投资", True), ("某律师事务所", "other", "", False), ("个人投资者", "other", "", False), ("Foo Limited", "other", "", False)])
def test_eligibility(spark, name, kind, context, ok):
    r = spark.createDataFrame([(name, kind, context)], "n string, k string, c string").select(R.eligibility(F.col("n"), F.col("k"), F.col("c")).alias("e")).first()
    assert r.e.eligible is ok and r.e.reason


def test_participants_of_several_days_need_their_own_date(spark):
    people = spark.createDataFrame([("r", "甲证券", "甲证券 2026年3月1日", datetime(2026, 3, 5)), ("r", "乙基金", "乙基金", datetime(2026, 3, 5))], "id string, name string, line string, p timestamp")
    events = spark.createDataFrame([("r", date(2026, 3, 1), True), ("r", date(2026, 3, 2), True)], "id string, start date, eligible boolean")
    got = [(r.name, r.start) for r in R.participant_occurrences(people, events, "id", "line", "p").collect()]
    assert got == [("甲证券", date(2026, 3, 1))]


def test_older_reading_takes_names_from_lines(spark):
    from tidemark.operators import participants as P

    text = "记录表：招商基金\n中信证券 王龙钰 分析师\n南方基金、某某财经公司、南方基金管理有限公司，先生公司\n本次交流。华夏基金\n参会名单。 华夏基金\n公司投资\nDM Capital Limited 首席分析师"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    got = sorted((r.line_no, r.name, r.analyst, text[r.start : r.start + len(r.name)]) for r in P.line_mentions(df, "id", "text").collect())
    assert got == [(1, "中信证券", "王龙钰", "中信证券"), (2, "先生公司", None, "先生公司"), (2, "南方基金", None, "南方基金"), (2, "南方基金管理有限公司", None, "南方基金管理有限公司"), (4, "华夏基金", None, "华夏基金"), (6, "DM Capital Limited", None, "DM Capital Limited")]


@pytest.mark.parametrize("value", [0.0, 1.0, 12.5, -3.25, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234567, 1e20, 0.1 + 0.2, 2.0 / 3])
def test_metrics_are_shown_with_six_digits(spark, value):
    from tidemark.operators import scoring

    df = spark.createDataFrame([([("m", value, "u")],), ([],), ([(None, None, None)],)], "x array<struct<name: string, value: double, unit: string>>")
    assert [r.s for r in df.select(scoring.shown_metric(F.col("x")).alias("s")).collect()] == [f"m {value:g} u", "—", "—"]


def test_questions_keep_their_digits(spark):
    text = "问：  0号项目进展如何？ \nQ2：1期产能？\n问： \n"
    got = spark.createDataFrame([(text,)], "t string").select(R.questions(F.col("t")).alias("q")).first().q
    assert [x.question for x in got] == ["0号项目进展如何？", "1期产能？"]


def test_assembled_records_count_names_of_wrapped_lists(spark):
    from tidemark.operators import participants as P

    text = "参与单位名称\n南方基金、正心谷中金公司、高\n毅资产、中信建投证\n券、平安银行\n时间 2026年5月6日\n"
    df = spark.createDataFrame([("r", "600001", text, datetime(2026, 5, 8))], "id string, code string, text string, published timestamp")
    known = spark.createDataFrame([("中金公司",), ("正心谷",)], "alias string")
    names = P.listed_names(df, "id", "text", known, "alias")
    assert names.first().names == ["南方基金", "正心谷", "中金公司", "高毅资产", "中信建投证券", "平安银行"]
    row = R.assembled(df, "id", "code", "text", "published", names).first()
    assert row.named == 3 and [str(d) for d in row.days] == ["2026-05-06"]
