"""The event rules look for places only where something matches, and hints need neither a shuffle nor stored hits."""

from pyspark.sql import functions as F

from tidemark.operators import extraction
from tidemark.operators.extraction_rules import RULES

TEXTS = ["产品涨价公告\n公司产品涨价，上调幅度为5%，利好业绩。", "政策利好公告\n以旧换新政策利好落地，公司直接受益。", "政策公告 以旧换新\n以旧换新政策终止，决定取消补贴。", "关于召开股东大会的公告\n公司将召开股东大会。", "", None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hints_are_made_in_the_scan(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    out = extraction.event_type_hint(docs, "id", "text")
    assert "Exchange" not in plan(out)
    assert {r.id: r.hint for r in out.collect()} == {0: "price_increase", 1: "direct_policy_benefit", 2: None, 3: None, 4: None, 5: None}


def test_hints_are_the_first_types_that_detect_gives(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS) if t], "event_id string, body string")
    docs = docs.select("event_id", F.lit("s").alias("stock_code"), F.col("event_id").alias("document_id"), F.lit("cninfo").alias("provider_key"), F.substring_index("body", "\n", 1).alias("title"), "body")
    want = {r.event_id: r.hint for r in extraction.detect(docs, RULES).groupBy("event_id").agg(F.min_by("event_type", "rule").alias("hint")).collect()}
    got = {r.event_id: r.hint for r in extraction.event_type_hint(docs, "event_id", "body").collect() if r.hint}
    assert got == want


def test_gates_and_counter_evidence_are_compiled(spark):
    docs = spark.createDataFrame([("t", "b")], "title string, body string")
    kinds = docs.select(extraction.counter_evidence(F.col("title"), F.col("body"), F.lit(False)).alias("k"))
    assert "filter(" not in plan(kinds).split("\n", 2)[2].split("exists(")[0]
    rows = spark.createDataFrame([("项目公告", "合同终止，是否可能落地"), ("增长公告", "项目终止。"), ("公告", "无")], "title string, body string")
    got = [r.k for r in rows.select(extraction.counter_evidence(F.col("title"), F.col("body"), F.lit(False)).alias("k")).collect()]
    assert got == [["high_uncertainty", "partial"], ["high_uncertainty"], []]
