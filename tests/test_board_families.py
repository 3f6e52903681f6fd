"""Families of board rows."""

import duckdb
import pytest

from tidemark import plans
from tidemark.operators.folds import board_dedupe


@pytest.mark.parametrize(
    ("kind", "rows", "kept"),
    [
        ("earnings", [("2026年半年度报告", ["1"]), ("2026年半年度报告摘要", ["2"])], [0]),
        ("earnings", [("2026年半年度报告", ["1"]), ("2025年半年度报告摘要", ["2"])], [0, 1]),
        ("buyback_or_increase", [("关于回购股份的公告", ["1"]), ("首次增持进展", ["2"])], [0]),
        ("approval", [("获得药品注册批件", ["1"]), ("获得药品 注册批件。", ["2"])], [0]),
        ("contract", [("签订重大合同公告", ["1"]), ("签订重大合同公告", ["2"])], [0, 1]),
        ("contract", [("签订重大合同公告", ["1"]), ("签订 重大合同，公告", [])], [0]),
        ("contract", [("", []), (None, []), ("，。", [])], [0, 1, 2]),
    ],
)
def test_families(spark, kind, rows, kept):
    df = spark.createDataFrame([(i, "600000", kind, t, a) for i, (t, a) in enumerate(rows)], "i int, code string, kind string, title string, amounts array<string>")
    out = board_dedupe(df, ["code", "kind"], ["i"], "title", "amounts", kind="kind")
    assert out.columns == df.columns and sorted(r.i for r in out.collect()) == kept


def test_parts_with_alike_names_and_nulls(spark, tmp_path):
    """cold rod and old rod are alike as titles, and the query's SQL keeps both; a null size or name is a value of its own."""
    rows = [(0, "cold rod", 7, 5.0), (1, "old rod", 7, 4.0), (2, "old rod", 7, 6.0), (3, "old rod", None, 9.0), (4, "old rod", None, 8.0), (5, "old rod", 8, None), (6, "old rod", 8, 1.0), (7, None, 7, 1.0), (8, None, 7, 1.0)]
    made = spark.createDataFrame([(*r, "b", "t") for r in rows], "p_partkey long, p_name string, p_size int, p_retailprice double, p_brand string, p_type string")
    made.write.parquet(f"{tmp_path}/part.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = sorted(r[0] for r in duck.execute(plans.ORACLE["board_family_dedupe"]).fetchall())
    assert sorted(r.p_partkey for r in plans.QUERIES["board_family_dedupe"](spark, str(tmp_path)).collect()) == want == [0, 2, 3, 6, 7]
