"""Persistent clustering and the news folds."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators.clustering import cluster_documents
from tidemark.operators.folds import anchor_dedupe, indel_ratio, leader_clusters

T0 = datetime(2026, 1, 10, 9)
DOC = "document_id string, at timestamp, title string, body string, url string, content_hash string, kind_hint string, codes array<string>"


def doc(i, hours, title, body="", codes=("600000",), url=None, digest=None, hint=None):
    return (i, T0 + timedelta(hours=hours), title, body, url, digest, hint, list(codes))


def clusters(spark, rows, known=None):
    out = cluster_documents(spark.createDataFrame(rows, DOC), known).collect()
    return {r.document_id: r for r in out}


def test_merge_window_is_72_hours_and_history_links_up_to_180_days(spark):
    got = clusters(spark, [doc("a", 0, "公司签订重大合同公告"), doc("b", 72, "公司签订重大合同公告"), doc("c", 72 + 73, "公司签订重大合同公告"), doc("d", 24 * 200 + 200, "公司签订重大合同公告")])
    assert got["a"].event_id == got["b"].event_id != got["c"].event_id
    assert got["c"].historical_event_id == got["a"].event_id
    assert got["d"].historical_event_id is None


def test_other_code_or_other_amount_keeps_documents_apart(spark):
    got = clusters(spark, [doc("a", 0, "签订合同公告", "合同金额5亿元"), doc("b", 1, "签订合同公告", "合同金额6亿元"), doc("c", 1, "签订合同公告", "合同金额5亿元", codes=["000001"])])
    assert len({r.event_id for r in got.values()}) == 3


def test_report_and_summary_of_a_day_are_one_event(spark):
    got = clusters(spark, [doc("a", 0, "2026年半年度报告", "净利润1亿元"), doc("b", 1, "2026年半年报报告摘要", "净利润2亿元")])
    assert got["a"].event_id == got["b"].event_id


def test_a_second_run_changes_nothing(spark):
    rows = [doc("a", 0, "甲公司获批新药"), doc("b", 3, "甲公司获批新药"), doc("c", 4, "乙公司年度业绩预告净利润增长")]
    first = clusters(spark, rows)
    known = spark.createDataFrame([(k, r.event_id) for k, r in first.items()], "document_id string, event_id string")
    assert {k: r.event_id for k, r in clusters(spark, rows, known).items()} == {k: r.event_id for k, r in first.items()}


def test_leader_clusters_join_by_time_code_and_title(spark):
    rows = [("1", T0, "公司发布业绩公告", ["1"]), ("2", T0 - timedelta(hours=5), "公司发布业绩公告", ["1", "2"]), ("3", T0 - timedelta(hours=7), "公司发布业绩公告", ["1"]), ("4", T0, "公司发布业绩公告", ["9"]), ("5", T0, "", ["1"])]
    got = {r.article: r.event for r in leader_clusters(spark.createDataFrame(rows, "article string, at timestamp, title string, codes array<string>")).collect()}
    assert got["1"] == got["2"] and len(set(got.values())) == 4


def test_anchor_is_the_last_row_kept(spark):
    rows = [("q", i, T0 + timedelta(hours=h)) for i, h in enumerate((0, 20, 30, 50, 80))]
    kept = anchor_dedupe(spark.createDataFrame(rows, "k string, i int, at timestamp"), ["k"], "at", "i").collect()
    assert sorted(r.i for r in kept) == [0, 2, 4]


@pytest.mark.parametrize(("a", "b", "ratio"), [("", "", 100.0), ("abc", "abc", 100.0), ("abc", "abd", 200 * 2 / 6), ("a", "", 0.0), ("公司公告", "公司发布公告", 80.0)])
def test_indel_ratio(a, b, ratio):
    assert indel_ratio(a, b) == pytest.approx(ratio)


def test_a_document_without_codes_is_an_event_of_its_own(spark):
    got = clusters(spark, [doc("a", 0, "公司签订重大合同公告", codes=()), doc("b", 1, "公司签订重大合同公告", codes=()), doc("c", 1, "公司签订重大合同公告")])
    assert len({r.event_id for r in got.values()}) == 3


def test_batches_equal_one_run_and_fold_only_what_they_touch(spark):
    import random

    from tidemark.operators.clustering import add_documents
    from tidemark.plans.session import cut

    rng, rows = random.Random(6), []
    titles = ["公司签订重大合同公告", "公司签订重大合同的公告", "关于回购股份的公告", "新药获批公告", "2026年半年度报告", "2026年半年度报告摘要", "股东减持计划", ""]
    for i in range(220):
        codes = rng.sample([f"{c:06d}" for c in range(40)], rng.choice([0, 1, 1, 1, 2]))
        rows.append(doc(f"d{i:03d}", rng.randrange(24 * 400), rng.choice(titles), rng.choice(["", "金额5亿元", "金额6亿元", "客户：甲方"]), codes, url=rng.choice([None, "u1", "u2"])))
    want = {r.document_id: (r.event_id, r.historical_event_id) for r in cluster_documents(spark.createDataFrame(rows, DOC)).collect()}
    rng.shuffle(rows)
    stored, folded = None, []
    for batch in (rows[:90], rows[90:200], rows[200:219], rows[210:220]):
        stored = cut(add_documents(stored, spark.createDataFrame(batch, DOC)))
        folded.append(stored.where("refolded").count())
    assert {r.document_id: (r.event_id, r.historical_event_id) for r in stored.collect()} == want
    left = stored.where("not refolded").count()
    assert folded[0] == 90 and left > 20 and folded[3] < 200
    touched = {c for r in rows[219:220] for c in r[7]}
    assert not any(touched & set(r.codes) for r in stored.where("not refolded").collect())


def test_a_long_block_gives_up_its_documents_on_the_way(spark):
    rows = [doc(f"d{i:05d}", i, f"第{i // 60}号合同公告", f"金额{i // 60 + 1}亿元") for i in range(3000)]
    got = clusters(spark, rows)
    assert len(got) == 3000 and len({r.event_id for r in got.values()}) == 50
    assert all(got[f"d{i:05d}"].event_id == got[f"d{i // 60 * 60:05d}"].event_id for i in range(3000))
