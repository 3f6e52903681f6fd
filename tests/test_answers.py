"""Answers of models: strict checks, cache and fallback."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers as A

METRIC = {"name": "金额", "value": 5, "unit": "亿元", "comparison_basis": None, "comparison_ratio": None, "evidence_id": "d1:1"}
GOOD = {"event_type": "major_contract", "direction": "positive", "certainty": 0.8, "materiality_level": 2, "unexpectedness": 50, "novelty": 99.5, "metrics": [METRIC], "counter_evidence": [{"kind": "partial"}], "evidence_ids": ["d1:1", "llm:x"], "positive_mechanism": None}
WITHOUT = {k: v for k, v in GOOD.items() if k != "novelty"}
CASES = [
    (json.dumps(GOOD), True), (json.dumps(GOOD | {"metrics": [], "counter_evidence": [], "evidence_ids": []}), True), (json.dumps(GOOD | {"certainty": 1, "positive_mechanism": "x"}), True), ("  " + json.dumps(GOOD) + "\n", True), (json.dumps(GOOD | {"event_type": A.UNSUPPORTED}), True),
    ("```json\n" + json.dumps(GOOD) + "\n```", False), (json.dumps(GOOD)[:-1], False), (json.dumps([GOOD]), False), ("", False), (None, False), ("5", False), (json.dumps(WITHOUT), False), (json.dumps(GOOD | {"event_type": "other"}), False), (json.dumps(GOOD | {"direction": None}), False),
    (json.dumps(GOOD | {"certainty": 1.01}), False), (json.dumps(GOOD | {"certainty": "0.5"}), False), (json.dumps(GOOD | {"certainty": True}), False), (json.dumps(GOOD | {"materiality_level": 2.0}), False), (json.dumps(GOOD | {"materiality_level": 5}), False), (json.dumps(GOOD | {"novelty": -1}), False),
    (json.dumps(GOOD | {"metrics": {}}), False), (json.dumps(GOOD | {"metrics": [5]}), False), (json.dumps(GOOD | {"metrics": [{k: v for k, v in METRIC.items() if k != "unit"}]}), False), (json.dumps(GOOD | {"counter_evidence": [{"kind": "odd"}]}), False), (json.dumps(GOOD | {"counter_evidence": None}), False),
    (json.dumps(GOOD | {"evidence_ids": [""]}), False), (json.dumps(GOOD | {"evidence_ids": [5]}), False), (json.dumps(GOOD | {"evidence_ids": ["d9:1"]}), False), (json.dumps(GOOD | {"positive_mechanism": 3}), False),
]


def test_only_whole_answers_hold(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, content string").withColumn("v", A.parsed(F.col("content")))
    got = {r.i: r.h for r in df.select("i", A.holds(F.col("v"), F.array(F.lit("d1"), F.lit("d2"))).alias("h")).collect()}
    assert got == {i: h for i, (_, h) in enumerate(CASES)}


@pytest.mark.parametrize(("certainty", "said", "stage"), [(0.8, None, "signed"), (0.97, None, "executed"), (0.1, "", "rumor"), (0.5, "rumor", "rumor")])
def test_fields(spark, certainty, said, stage):
    content = json.dumps(GOOD | {"certainty": certainty, "certainty_stage": said})
    r = spark.createDataFrame([(content,)], "c string").select(A.fields(A.parsed(F.col("c"))).alias("f")).first().f
    assert (r.certainty_stage, r.event_type, r.materiality_level, r.novelty, r.evidence_ids, r.no_valid_signal) == (stage, "major_contract", 2, 99.5, ["d1:1", "llm:x"], False)


def test_cache_and_fallback(spark):
    cache = "document_id string, model string, prompt_version string, content_hash string, response string, answered_at int"
    old = spark.createDataFrame([("a", "m", "1", "h1", "r1", 1), ("b", "m", "1", "h0", "r2", 1), ("c", "m", "0", "h3", "r3", 1)], cache)
    docs = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), (None, "h4")], "document_id string, content_hash string")
    assert {r.document_id: r.response for r in A.from_cache(docs, old, "m", "1").collect()} == {"a": "r1", "b": None, "c": None, None: None}
    new = A.to_cache(old, spark.createDataFrame([("b", "m", "1", "h2", "r4", 2), ("a", "m", "1", "h1", "r0", 0)], cache))
    assert {r.document_id: r.response for r in A.from_cache(docs, new, "m", "1").collect()} == {"a": "r1", "b": "r4", "c": None, None: None}
    asked = spark.createDataFrame([("e1", "s1"), ("e1", "s2"), ("e2", "s1"), ("e3", "s1")], "event_id string, stock string")
    mine = spark.createDataFrame([("e1", "s1", True, 4), ("e1", "s2", False, 4), ("e3", "s1", False, 1)], "event_id string, stock string, holds boolean, level int")
    rules = spark.createDataFrame([("e1", "s1", 1), ("e1", "s2", 2), ("e2", "s1", 3)], "event_id string, stock string, level int")
    got = A.with_fallback(asked, mine, rules, ["event_id", "stock"], ["level"])
    assert sorted(map(tuple, got.collect())) == [("e1", "s1", 4, "llm"), ("e1", "s2", 2, "rules_fallback"), ("e2", "s1", 3, "rules_fallback")]
