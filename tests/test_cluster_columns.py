"""Clustering leaves trigrams out of what is shuffled, and takes them only where a test comes to them."""

import random

import pyarrow as pa

from tidemark.operators import clustering as C
from tidemark.plans.session import cut

DOC = "document_id string, at timestamp, title string, body string, url string, content_hash string, kind_hint string, codes array<string>"


def test_no_grams_are_shuffled_or_stored(spark):
    one = spark.createDataFrame([("a", None, "公司签订重大合同公告", "金额5亿元", None, None, None, ["1"])], DOC)
    assert "grams" not in cut(C.add_documents(None, one)).columns


def test_columns_as_lists_equal_those_of_arrow():
    ints, texts = pa.array([1, None, 3]), pa.array(["a", None, ""])
    lists = pa.array([["a", None], None, [], ["b"]], pa.list_(pa.string()))
    assert C._values(ints) == ints.to_pylist() and C._values(texts) == texts.to_pylist()
    assert C._values(lists) == [["a", None], [], [], ["b"]] and C._values(lists.slice(2)) == [[], ["b"]] and C._values(lists.slice(4)) == []


def test_many_texts_of_a_cluster_meet_those_that_are_alike():
    rng = random.Random(3)
    words = ["合同", "回购", "分红", "投产", "获批", "收购", "增长", "公告", "股东", "项目"]
    texts = ["".join(rng.choices(words, k=12)) for _ in range(60)] + ["", "公"]
    cluster = C._Cluster("c", None)
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    seen = []
    for said in texts:
        for other in (said, said[:-2], said + "合同公", "".join(rng.choices(words, k=12))):
            g = grams(other)
            want = any(g and h and len(g & h) / (len(g) * len(h)) ** 0.5 >= C.TRIGRAM_LIKENESS for h in map(grams, seen))
            assert cluster._text(other) == want
        cluster.said[said] = None
        seen.append(said)
    assert cluster.indexed > C.FEW_TEXTS
