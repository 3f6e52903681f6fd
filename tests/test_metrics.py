"""Golden values of boards, bucket statistics, scores and state tables."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import text as X
from tidemark.operators import boards as B
from tidemark.operators import metrics as M
from tidemark.operators import scoring as S
from tidemark.operators import state


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def counts(*xs):
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<int>")


@pytest.mark.parametrize(("current", "history", "z"), [(8, [4] * 5, 4.0), (8, [8] * 5, 0.0), (10, [8] * 5, 2.0), (3, [], 3.0), (5, [1], 4.0)])
def test_z20(spark, current, history, z):
    assert one(spark, z=M.z20(F.lit(current), counts(*history))).z == pytest.approx(z)


def test_warming(spark):
    w = one(spark, w=M.warming(F.lit(9), counts(1, 2, 3, 4, 5))).w
    assert (round(w.score, 3), w.mean, w.variance, round(w.predictive, 4), w.change) == (3.162, 3.0, 2.5, 3.6, 6.0)
    assert one(spark, w=M.warming(F.lit(9), counts(1, 2, 3, 4))).w is None


def test_midrank_needs_its_sample(spark):
    rows = spark.createDataFrame([("a", v) for v in (3, 5, 1, 2, 4)] + [("b", 1), ("b", 2)], "i string, v int").withColumn("p", B.midrank_percentile("v", ["i"], 5)).collect()
    assert {(r.i, r.v): r.p for r in rows}[("a", 5)] == 90.0 and all(r.p is None for r in rows if r.i == "b")
    universe = spark.createDataFrame([("a", 0)] * 19 + [("a", 1)], "i string, v int").withColumn("p", B.midrank_percentile("v", ["i"], 20))
    assert universe.agg(F.max("p")).first()[0] == 97.5


def test_average_rank(spark):
    rows = spark.createDataFrame([(1,), (1,), (0,)], "b int").withColumn("p", B.average_rank_percentile("b")).collect()
    assert sorted(r.p for r in rows) == [0.0, 75.0, 75.0]
    assert spark.createDataFrame([(7,)], "b int").withColumn("p", B.average_rank_percentile("b")).first().p == 100.0


def test_buckets_end_at_the_last_day(spark):
    days = spark.createDataFrame([(date(2026, 1, 1) + timedelta(days=i),) for i in range(120)], "day date")
    out = sorted((r.bucket, r.start, r.end, r.n) for r in M.trading_buckets(days).collect())
    assert len(out) == 6 and out[0][2] == date(2026, 4, 30) and all(r[3] == 20 for r in out)
    assert M.trading_buckets(days.limit(110), complete=True).count() == 5


def test_persistence(spark):
    days = M.weekdays(spark.createDataFrame([(date(2026, 3, 2), date(2026, 3, 13))], "s date, e date"), "s", "e")
    act = spark.createDataFrame([("x", "g1", date(2026, 3, 2)), ("x", "g2", date(2026, 3, 2)), ("x", "g1", date(2026, 3, 10)), ("x", "g3", date(2025, 1, 1))], "k string, g string, d date")
    r = M.persistence(act, days, "k", "g", "d").first()
    assert (r.active_weeks, r.active_week_ratio, r.unique_groups, r.repeat_ratio) == (2, 1.0, 3, pytest.approx(1 / 3))
    assert r.concentration == pytest.approx(2 / 3)
    ten = spark.createDataFrame([("x", f"g{i}", date(2026, 3, 2)) for i in range(10)], "k string, g string, d date")
    r = M.persistence(ten, days, "k", "g", "d").first()
    assert (r.concentration, r.repeat_ratio, r.active_weeks) == (1.0, 0.0, 1)


def test_depth_is_null_without_questions(spark):
    r = one(spark, a=M.depth_score(F.lit(3), F.lit(0), F.lit(1), F.lit(4)), b=M.depth_score(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    assert r.a == 0.4375 and r.b is None


def test_score_and_board(spark):
    lit = F.lit
    p = S.score(S.source_confidence(lit("cninfo")), lit(0.9), lit(3), lit(75.0), lit(100.0), lit(50.0), lit(0.0))
    r = one(spark, p=p, b=S.board(p, lit(3), lit(0.9), lit(False)), c=S.source_confidence(lit("bse")))
    assert r.p == pytest.approx(67.5) and r.b == "confirmed_positive" and r.c == 0.6


def test_penalties_add_up_to_eighty(spark):
    t, f, lit = F.lit(True), F.lit(False), F.lit
    assert one(spark, p=S.penalty(t, f, lit(25.0), lit(0), lit(30.0), t)).p == 80.0
    assert one(spark, p=S.penalty(t, t, lit(50.0), lit(1), lit(100.0), f)).p == 50.0


def test_timeliness(spark):
    end = datetime(2026, 1, 2)
    at = lambda h: D.timeliness(F.lit(end + timedelta(hours=h)), F.lit(end - timedelta(hours=24)), F.lit(end))
    assert list(one(spark, a=at(0), b=at(-12), c=at(-24), d=at(-30), e=at(1))) == [100.0, 50.0, 0.0, 0.0, 100.0]


def test_text_normal_forms(spark):
    lit = F.lit
    r = one(spark, a=X.normalize_title(lit("【快讯】 公司：发布公告！")), b=X.normalize_question(lit("贵司 产能？如何！")), c=X.report_period(lit("2026年半年报摘要")), d=X.canonical_url(lit("http://A.com//x//y?z#q")))
    assert list(r) == ["公司发布公告", "贵司产能如何", "2026-半年度", "https://a.com/x/y"]


def test_amounts_and_shares(spark):
    lit = F.lit
    r = one(spark, a=X.parse_amount(lit("约1,234.5万元和2亿")), b=X.parse_percent(lit("增长12.5%")), c=X.parse_percent(lit("3倍")), d=X.parse_percent(lit("12")), e=X.amounts(lit("2亿元、2亿元和5万元")), f=X.net_profit(lit("净利润较上年同期增加5万元")))
    assert (r.a.yuan, r.a.unit, r.a.value) == (12_345_000.0, "万元", 1234.5)
    assert r.b == pytest.approx(0.125) and r.c == 3.0 and r.d is None and r.e == ["200000000", "50000"] and r.f is None


def test_brokers_that_rate_are_dropped(spark):
    stocks = F.array(F.struct(F.lit("1").alias("code"), F.lit("中信证券").alias("name")), F.struct(F.lit("2").alias("code"), F.lit("贵州茅台").alias("name")))
    r = one(spark, a=X.without_raters(stocks, F.lit("中信证券：维持贵州茅台买入评级"), F.lit(""), F.lit("")), b=X.without_raters(stocks, F.lit("中信证券发布年报"), F.lit(""), F.lit("")))
    assert [s.name for s in r.a] == ["贵州茅台"] and len(r.b) == 2


def test_noise_reasons(spark):
    texts = ["", "abc", "庄家什么时候拉升", "主力产能如何", "涨停吗今天", "啊" * 10 + "?", "公司产能如何"]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", X.noise_reason(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in rows] == ["空内容", "空内容", "纯走势/庄家/盘口", None, "垃圾内容", "无意义重复", None]


def test_relative_times(spark):
    now = F.lit(datetime(2026, 3, 10, 12, 0))
    said = ["刚刚", "5分钟前", "2小时前", "昨天 9:05", "2026-01-02 03:04", "what"]
    rows = spark.createDataFrame(enumerate(said), "i int, s string").select("i", D.relative_time(F.col("s"), now).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [datetime(2026, 3, 10, 12), datetime(2026, 3, 10, 11, 55), datetime(2026, 3, 10, 10), datetime(2026, 3, 9, 9, 5), datetime(2026, 1, 2, 3, 4), None]
    y = lambda m: D.latest_year(F.lit(m), F.lit(5), F.lit(8), F.lit(0), now)
    r = one(spark, a=y(3), b=y(12), c=D.from_epoch_ms(F.lit(1_767_225_600_000)))
    assert r.a == datetime(2026, 3, 5, 8) and r.b == datetime(2025, 12, 5, 8) and r.c == datetime(2026, 1, 1, 8)


def test_round_robin_and_budget(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 10), ("c", 20)], "b string, i int")
    assert [(r.b, r.i) for r in state.round_robin(rows, "b", [F.asc("i")], 5).orderBy("turn", "b").collect()] == [("a", 0), ("b", 10), ("c", 20), ("a", 1), ("a", 2)]
    shares = [one(spark, s=state.budget_share(F.lit(i), F.lit(3), F.lit(10))).s for i in range(3)]
    assert shares == [4, 3, 3]


def test_sticky_members_fail_instead_of_leaving(spark):
    now = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "k string, s boolean")
    before = spark.createDataFrame([("b",), ("d",)], "k string")
    assert {r.k: r.failing for r in state.sticky_members(now, before, ["k"], "s").collect()} == {"a": False, "b": True, "d": True}
