"""Folds and joins against plain forms."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import folds, joins
from tidemark.operators import research as R

T0 = datetime(2026, 1, 1)


def test_anchors_equal_a_loop_and_keep_rows_without_a_time(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), i, T0 + timedelta(hours=rnd.randrange(400)), None) for i in range(300)] + [("a", 1000, None, "x"), ("a", 1001, None, None), (None, 1002, T0, "y")]
    want = {1000, 1001, 1002}
    for key in "abc":
        anchor = None
        for at, i in sorted((r[2], r[1]) for r in rows if r[0] == key and r[2]):
            if anchor is None or at - anchor > timedelta(hours=24):
                anchor = at
                want.add(i)
    out = folds.anchor_dedupe(spark.createDataFrame(rows, "k string, i int, at timestamp, extra string"), ["k"], "at", "i")
    assert out.columns == ["k", "i", "at", "extra"] and {r.i for r in out.collect()} == want
    assert folds.anchor_dedupe(spark.createDataFrame([], "k string, i int, at timestamp"), ["k"], "at", "i").count() == 0


def test_leaders_equal_a_loop(spark):
    rnd = random.Random(2)
    titles = ["公司发布年度业绩公告", "公司发布年度业绩公告二", "关于回购股份的进展", "", None]
    rows = [(i, T0 + timedelta(minutes=rnd.randrange(6000)), rnd.choice(titles), rnd.sample(["a", "b", "c", "d"], rnd.randrange(3))) for i in range(250)]
    events, want = [], {}
    for i, at, title, codes in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0])):
        for e in events:
            if e[1] - at <= timedelta(hours=6) and e[3] & set(codes) and title and e[2] and folds.indel_ratio(title, e[2]) >= 90:
                e[3].update(codes)
                break
        else:
            e = (i, at, title, set(codes))
            events.append(e)
        want[i] = e[0]
    got = folds.leader_clusters(spark.createDataFrame(rows, "article int, at timestamp, title string, codes array<string>")).collect()
    assert {r.article: r.event for r in got} == want


@pytest.mark.parametrize("least", [0.5, 0.82])
def test_alike_names_equal_all_pairs(spark, least):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(n,) for n in [*names, names[0]]], "n string").withColumn("k", F.lit(1)).withColumn("g", X.trigrams(F.col("n")))
    grams = {n: {n[i : i + 3] for i in range(len(n) - 2)} for n in names}
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] and grams[b] and len(grams[a] & grams[b]) / (len(grams[a]) * len(grams[b])) ** 0.5 >= least - 1e-12}
    assert {(r.a, r.b) for r in joins.alike_pairs(df, ["k"], "n", "g", least).collect()} == want


def test_edit_pairs_equal_all_pairs(spark):
    rnd = random.Random(4)
    names = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(7))) for _ in range(60)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        return row[-1]

    df = spark.createDataFrame([(n, 1) for n in [*names, *names]] + [(None, 1)], "n string, k int")
    want = {(a, b, distance(a, b)) for a in names for b in names if a < b and distance(a, b) <= 2}
    assert {(r.a, r.b, r.distance) for r in joins.edit_pairs(df, ["k"], "n", 2).collect()} == want


def test_newest_before_takes_the_larger_id_of_equal_times_and_leaves_nulls(spark):
    past = spark.createDataFrame([("a", "p1", T0), ("a", "p2", T0), ("a", "p3", T0 + timedelta(days=9)), (None, "p4", T0)], "k string, past string, past_at timestamp")
    rows = spark.createDataFrame([("a", 1, T0 + timedelta(hours=72)), ("a", 2, T0 + timedelta(hours=71)), ("a", 3, T0 + timedelta(days=181)), (None, 4, T0 + timedelta(days=4)), ("a", 5, None), ("b", 6, T0)], "k string, i int, at timestamp")
    got = {r.i: r.past for r in joins.newest_before(rows, past, "k", "i", "at", "past", "past_at", "72 hours", "180 days").collect()}
    assert got == {1: "p2", 3: "p3"}


def test_mention_context_is_the_list_item(spark):
    line = "参与单位：平安银行研究部、 招商银行（上海） ，华泰证券"
    rows = [(line, "平安银行", "参与单位：平安银行研究部"), (line, "招商银行", "招商银行（上海）"), (line, "华泰证券", "华泰证券"), (line, "不在", "不在")]
    out = spark.createDataFrame(rows, "line string, name string, want string").select("want", R.mention_context(F.col("line"), F.col("name")).alias("got")).collect()
    assert all(r.got == r.want for r in out)


def test_records_are_assembled(spark):
    text = "活动时间：2026年5月6日\n调研方式：现场调研\n参与单位名称：约30家机构，平安银行研究部、招商银行、华泰证券：王龙钰\n地点：公司\n问：产能利用率和订单如何？\n问：未来规划？\n"
    df = spark.createDataFrame([("r", "600000", text, datetime(2026, 5, 8)), ("none", None, text, datetime(2026, 5, 8)), ("blank", "600000", " ", datetime(2026, 5, 8))], "id string, code string, text string, published timestamp")
    out = R.assembled(df, "id", "code", "text", "published").collect()
    assert len(out) == 1
    r = out[0]
    assert (r.kind, r.reported, r.question_count, r.high_depth, r.precision, [str(d) for d in r.days]) == ("survey", 30, 2, 0, "explicit", ["2026-05-06"])
    assert r.depth_counts == {"low": 1, "medium": 1, "high": 0} and sum(r.topic_counts.values()) == 2 and r.activity_id.startswith("activity:")
    assert r.named >= 1
