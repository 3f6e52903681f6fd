"""Documents learn their block from their own codes, tests are slim where a text holds nothing, and batches cut anywhere."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import clustering as C
from tidemark.operators.folds import in_blocks, leader_clusters

DOC = "document_id string, at timestamp, title string, body string, url string, content_hash string, kind_hint string, codes array<string>"


def _blocks_of(spark, rows, **more):
    got = in_blocks(spark.createDataFrame(rows, "id string, codes array<string>"), "id", "codes", **more).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.block, set()).add((r.id, tuple(r.codes)))
    return groups


def test_documents_of_one_code_are_shuffled_once(spark):
    rows = [(str(i), None, "公司签订重大合同公告", "", None, None, None, [str(i % 3)]) for i in range(9)]
    plan = C.cluster_documents(spark.createDataFrame(rows, DOC))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_blocks_join_codes_through_chains_and_keys(spark):
    chain = [(f"a{i}", [f"c{i + k:03d}" for k in (1, 0)]) for i in range(40)]
    others = [("one", ["z"]), ("two", ["z"]), ("none", []), ("bare", [])]
    got = _blocks_of(spark, chain + others)
    assert got == {"c000": {(a, tuple(c)) for a, c in chain}, "z": {("one", ("z",)), ("two", ("z",))}, "#none": {("none", ())}, "#bare": {("bare", ())}}
    twice = [("d", ["x"]), ("d", ["y"]), ("e", ["y"]), ("f", ["w"]), ("g", []), ("g", ["v"])]
    assert sorted(map(sorted, _blocks_of(spark, twice).values())) == [[("d", ("x",)), ("d", ("y",)), ("e", ("y",))], [("f", ("w",))], [("g", ()), ("g", ("v",))]]


def test_many_roots_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(str(i), [f"m{i}", f"n{i}"]) for i in range(50)] + [(f"t{i}", [f"n{i}"]) for i in range(50)]
    want = _blocks_of(spark, rows)
    monkeypatch.setattr("tidemark.operators.folds.FEW_ROOTS", 3)
    assert _blocks_of(spark, rows) == want and len(want) == 50


def test_leaders_with_null_and_number_codes(spark):
    rows = [(1, "2026-01-05 10:00:00", "甲", [7, None]), (2, "2026-01-05 11:00:00", "甲", [7]), (3, "2026-01-05 11:00:00", "甲", None), (4, "2026-01-05 11:00:00", "甲", [None])]
    docs = spark.createDataFrame(rows, "article bigint, at string, title string, codes array<bigint>").withColumn("at", F.col("at").cast("timestamp"))
    assert {r.article: r.event for r in leader_clusters(docs).collect()} == {1: 2, 2: 2, 3: 3, 4: 4}


def test_noise_is_what_its_class_holds(spark):
    bare = X.TITLE_NOISE.split(")", 1)[1]
    assert X.TITLE_NOISE == r"(?![0-9A-Za-z一-鿿])" + bare
    chars = spark.createDataFrame([(f"甲{chr(i)} {chr(i)}b{chr(i)}",) for i in [*range(1, 0x3100), *range(0x4DF0, 0x4E10), *range(0x9FF0, 0xA010), *range(0xFE00, 0xFFFE)]], "s string")
    assert chars.where(F.regexp_replace("s", X.TITLE_NOISE, "") != F.regexp_replace("s", bare, "")).isEmpty()


def test_facts_of_texts_with_and_without_their_words(spark):
    rows = [("合同金额8亿元、3万和5元，客户：甲公司，收购乙公司，2026年3月5日",), ("8千，a1b2",), ("月",), ("",), (None,)]
    got = spark.createDataFrame(rows, "s string").select(X.amounts(F.col("s")).alias("a"), X.targets(F.col("s")).alias("t"), X.dates_in(F.col("s")).alias("d"), X.report_period(F.col("s")).alias("p")).collect()
    assert tuple(got[0]) == (["800000000", "30000", "5"], ["甲公司", "乙公司"], ["2026年3月5日"], None)
    assert all(tuple(r) == ([], [], [], None) for r in got[1:4]) and tuple(got[4]) == (None,) * 4


def test_a_run_of_one_row_and_batches_cut_anywhere():
    rng, day, rows = random.Random(5), 86_400, []
    for block in range(40):
        t, size = 0, rng.choice((1, 1, 2, 5))
        for i in range(size):
            gap = rng.choice((1, 60, 200)) * day
            t += gap
            rows.append({"__new": i == 0 or gap > C.HISTORY_SECONDS, "t": t, "document_id": f"{block}-{i}", "title": "公告", "norm": "公告", "said": "公告\n", "codes": [str(block)], "amounts": [], "targets": [], "dates": []})
    text, texts = pa.string(), pa.list_(pa.string())
    kinds = {"__new": pa.bool_(), "t": pa.int64(), "codes": texts, "amounts": texts, "targets": texts, "dates": texts}
    table = pa.Table.from_pylist(rows, pa.schema([(n, kinds.get(n, text)) for n in ("__new", *C._Document.FIELDS)]))
    folded = lambda n: sorted((tuple(r.values()) for b in C._folded(iter(table.to_batches(max_chunksize=n))) for r in b.to_pylist()), key=str)
    want = folded(len(rows))
    assert len(want) == len(rows) and any(r[2] for r in want) and all(folded(n) == want for n in (1, 2, 3, 7))
    alone = [r["document_id"] for r, after in zip(rows, [*rows[1:], {"__new": True}], strict=True) if r["__new"] and after["__new"]]
    got = {r[0]: r[1:] for r in want}
    assert alone and all(got[d] == (C._event_id(d), None) for d in alone)
