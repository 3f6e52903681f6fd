"""Properties of the pure helpers."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import plans
from tidemark.functions import text
from tidemark.operators.folds import indel_ratio
from tidemark.plans import session


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab公c", max_size=40), st.text("ab公c", max_size=40))
def test_indel_ratio_is_twice_the_common_share(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert indel_ratio(a, b) == want
    assert indel_ratio(b, a) == want


def test_an_amount_is_searched_for_once_for_each_part(spark):
    """The value and the unit had six searches of the text between them."""
    plan = spark.range(1).select(text.parse_amount(F.lit("约1,234.5万元").substr(F.lit(1), F.col("id") + 20)).alias("a")).select("a.*")._jdf.queryExecution()
    assert plan.analyzed().toString().count("regexp_extract(") == 2 and plan.optimizedPlan().toString().count("regexp_extract(") <= 2


def test_rows_of_a_small_table_are_spread(spark):
    """Articles and records were read and worked on in one task, however many there were."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n > 1 and session.spread(spark.range(100).coalesce(1), "id").rdd.getNumPartitions() == n
    for name in ("article_fields", "line_mentions"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [c_custkey" in plan and f", {n}" in plan
