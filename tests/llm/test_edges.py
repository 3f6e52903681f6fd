"""Repeated rows and empty tables where the other tests don't have them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import html_extract, vector_dedup

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "benchmark": "item_id long, text string",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("nothing"))
    real = "/root/testdata/sf0.001"
    for name in TABLES:
        spark.read.parquet(f"{real}/{name}.parquet").where("false").write.parquet(f"{d}/{name}.parquet")
    return d


def test_repeated_pages_are_each_returned(spark):
    page = "<body><p>One paragraph that is the page.</p></body>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(df).collect()) == [(0, "", 0), (1, "One paragraph that is the page.", 31), (1, "One paragraph that is the page.", 31)]


def test_a_vector_of_the_same_id_twice(spark):
    column = next(f.name for f in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").schema.fields if "array" in f.dataType.simpleString())
    v = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(1, v), (1, v), (2, v), (3, [0.0] * 64)], f"vec_id long, {column} array<float>")
    got = vector_dedup.link_vectors(df).collect()
    assert len(got) == 4 and {r.component_id for r in got if r.vec_id in (1, 2)} == {1} and {r.component_id for r in got if r.vec_id == 3} == {3}


def test_queries_on_empty_tables(spark, nothing):
    for name, query in entry.queries().items():
        if name.startswith("op"):
            assert query(spark, nothing).count() == 0, name


def test_pipeline_on_empty_tables(spark, nothing):
    assert corpus_pipeline.run(spark, nothing).count() == 0
