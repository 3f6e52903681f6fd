"""Event rules on small announcements."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extraction as E
from tidemark.operators.extraction_rules import RULES

DOC = "event_id string, stock_code string, document_id string, provider_key string, title string, body string"
CASES = [
    ("dividend", "cninfo", "2026年度现金分红方案实施公告", "公司现金分红2亿元，占净利润比例为30%，本次现金分红已实施完毕，股东回报提升。"),
    ("stock_dividend", "cninfo", "2026年度送股转增方案公告", "利润分配预案为每10股送3股转增2股。"),
    ("stopped", "cninfo", "关于终止现金分红方案的公告", "董事会决定终止现金分红方案。"),
    ("contract", "cninfo", "关于签订重大合同的公告", "公司签订重大合同，合同金额10亿元，占公司营业收入的20%，合同已签署。"),
    ("customer", "sse", "公司中标订单并进入供应链的公告", "公司获得订单，进入某某汽车供应链，批量供货。"),
    ("approval", "cninfo", "关于药品获批的公告", "公司产品获批，已取得药品注册证，将实现商业化。"),
    ("patent", "cninfo", "关于专利获批的公告", "公司专利获批，取得证书。"),
    ("mna", "cninfo", "关于收购股权的公告", "公司收购某公司股权，交易金额5亿元，增强协同，协议已签署。"),
    ("price", "ths", "产品涨价公告", "公司产品涨价，上调幅度为12%，利好业绩。"),
    ("policy_bad", "cninfo", "关于取消税收优惠的公告", "税收优惠取消，公司成本将受影响。"),
    ("risk", "cninfo", "关于撤销退市风险警示的公告", "公司申请撤销退市风险警示已获同意，涉及金额3亿元。"),
    ("incentive", "cninfo", "股权激励计划草案", "股权激励计划的激励对象为100人，授予数量为500万股，业绩考核指标为净利润增长。"),
    ("incentive_thin", "cninfo", "股权激励计划草案", "股权激励计划将实施。"),
    ("periodic_loss", "cninfo", "2026年半年度报告", "半年度报告显示净利润为-5000万元，业绩下降。"),
    ("nothing", "cninfo", "关于召开股东大会的公告", "公司将召开股东大会。"),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, "600000", name, provider, title, body) for name, provider, title, body in CASES]
    out = E.leading_facts(E.detect(spark.createDataFrame(rows, DOC))).collect()
    return {(r.event_id, r.event_type): r for r in out}


def test_rules_are_the_sixteen_types():
    assert len({r.name for r in RULES}) == 16


def test_cash_dividend_counts_and_stock_dividend_does_not(found):
    r = found["dividend", "shareholder_return"]
    assert (r.direction, r.level, r.stage, r.certainty) == ("positive", 4, "executed", 1.0)
    assert r.ratio == pytest.approx(0.3) and r.amount == pytest.approx(2e8)
    assert ("stock_dividend", "shareholder_return") not in found


def test_terminated_plan_is_negative_without_mechanism(found):
    r = found["stopped", "shareholder_return"]
    assert (r.direction, r.mechanism, r.level) == ("negative", None, 0)


def test_contract_ratio_gives_its_level(found):
    r = found["contract", "major_contract"]
    assert (r.direction, r.level, r.stage) == ("positive", 3, "signed")


def test_supply_relation_is_a_customer_event(found):
    assert ("customer", "major_contract") not in found and ("customer", "customer_breakthrough") not in found or found["customer", "customer_breakthrough"].direction == "positive"


def test_approval_is_executed_but_patents_are_no_approval(found):
    assert found["approval", "approval"].stage == "executed" and found["approval", "approval"].level == 2
    assert ("patent", "approval") not in found


def test_acquisition_reaches_three_with_two_pieces_of_evidence(found):
    assert found["mna", "mna"].level == 3


def test_price_ratio_and_policy_that_is_not_positive(found):
    assert found["price", "price_increase"].ratio == pytest.approx(0.12)
    assert ("policy_bad", "direct_policy_benefit") not in found


def test_lifted_risk_is_positive(found):
    r = found["risk", "risk_resolution"]
    assert (r.direction, r.level, r.stage) == ("positive", 2, "executed")


def test_incentive_needs_scope_size_and_target(found):
    assert found["incentive", "equity_incentive"].level == 2
    assert found["incentive", "equity_incentive"].counter == ["high_uncertainty"]
    assert found["incentive_thin", "equity_incentive"].mechanism is None


def test_reported_loss_is_no_upgrade(found):
    assert found["periodic_loss", "earnings_upgrade"].direction == "negative"


def test_no_event_without_headline(found):
    assert not [k for k in found if k[0] == "nothing"]


def test_hypothetical_end_is_no_terminal_state(spark):
    rows = [("若审批未通过，则终止本次收购。", "收购公告"), ("公司决定终止收购。", "收购公告"), ("收购顺利。", "终止收购公告"), ("存在失败风险。", "收购公告")]
    out = spark.createDataFrame(rows, "text string, title string").select(E.terminal_state(F.col("text"), F.col("title")).alias("t")).collect()
    assert [r.t for r in out] == [False, True, True, False]


def test_figures_come_from_the_best_section(spark):
    body = "风险提示\n净利润同比下降5%。\n主要财务数据\n归母净利润同比增长20%。"
    r = spark.createDataFrame([(body,)], "b string").select(E.figures(F.col("b"), "净利润|归母净利润").alias("f"), E.section_rank(F.col("b"), F.lit(6)).alias("a"), E.section_rank(F.col("b"), F.lit(0)).alias("b")).first()
    assert r.f.startswith("归母净利润同比增长20%") and (r.a, r.b) == (2, 1)


def test_novelty_and_unexpectedness_come_from_the_older_event(spark):
    docs = [("a", "合同公告", "金额5亿元"), ("b", "合同公告", "金额5亿元"), ("c", "合同", "金额6亿元"), ("c", "补充", "另有1亿元"), ("d", "合同", "没有金额"), ("e", "首次合同", "金额5亿元，超预期"), ("f", None, None), (None, "x", "y")]
    links = [("b", "a"), ("c", "a"), ("d", "a"), ("e", "gone"), ("f", None)]
    found = spark.createDataFrame([(x,) for x in "abcdefz"], "event_id string")
    got = E.with_history(found, spark.createDataFrame(docs, "event_id string, title string, body string"), spark.createDataFrame(links, "event_id string, historical_event_id string"))
    assert {r.event_id: (r.novelty, r.unexpectedness) for r in got.collect()} == {"a": (100.0, 50.0), "b": (30.0, 25.0), "c": (60.0, 25.0), "d": (30.0, 0.0), "e": (30.0, 100.0), "f": (100.0, 50.0), "z": (None, None)}
