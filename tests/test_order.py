"""Numbers of all rows in an order."""

from pyspark.sql import functions as F

import pytest

from tidemark.operators import boards
from tidemark.operators.order import numbered, running_total


@pytest.mark.parametrize("one_task", [0, 1000])
def test_numbers_follow_the_order(spark, one_task):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("b"))
    order = [F.col("a").desc(), F.col("b").asc_nulls_last()]
    got = sorted((r.n, r.a, r.b) for r in numbered(df, *order, one_task=one_task).collect())
    want = sorted(((r.a, r.b) for r in df.collect()), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert [g[0] for g in got] == list(range(1, 501)) and [(a, b) for _, a, b in got] == want


@pytest.mark.parametrize("one_task", [0, 1000])
def test_sums_up_to_each_row(spark, one_task):
    df = spark.range(200).select("id", (F.col("id") % 7).alias("v"))
    got = [r.s for r in running_total(df, F.desc("id"), amount="v", name="s", one_task=one_task).orderBy(F.desc("id")).collect()]
    assert got == [sum(i % 7 for i in range(j, 200)) for j in range(199, -1, -1)]


@pytest.mark.parametrize("one_task", [0, 1000])
@pytest.mark.parametrize("partition", [[], ["p"], ["p", "q"]])
def test_percentiles_equal_counts(spark, one_task, partition):
    rows = [(i, None if i % 11 == 0 else i % 3, i % 2, None if i % 13 == 0 else i * 7 % 10) for i in range(90)] + [(90, 5, 0, 1)]
    df = spark.createDataFrame(rows, "id int, p int, q int, v int")
    at = {"p": 1, "q": 2}

    def want(r, least=None):
        own = [x for x in rows if all(x[at[c]] == r[at[c]] for c in partition)]
        low = -1 if r[3] is None else r[3]
        below, equal = sum((-1 if x[3] is None else x[3]) < low for x in own), sum(x[3] == r[3] for x in own)
        if least is None:
            return 100.0 if len(own) == 1 else (below + (equal - 1) / 2) / (len(own) - 1) * 100
        return (below + equal / 2) / len(own) * 100 if len(own) >= least else None

    got = {r.id: r.percentile for r in boards.average_rank_percentiles(df, "v", partition, one_task=one_task).collect()}
    assert got == pytest.approx({r[0]: want(r) for r in rows})
    got = {r.id: r.percentile for r in boards.midrank_percentiles(df, "v", partition, 5, one_task=one_task).collect()}
    for r in rows:
        assert got[r[0]] == pytest.approx(want(r, 5)) if want(r, 5) is not None else got[r[0]] is None


@pytest.mark.parametrize("one_task", [0, 1000])
def test_no_rows(spark, one_task):
    assert numbered(spark.range(0), F.col("id"), one_task=one_task).count() == 0
