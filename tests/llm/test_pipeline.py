"""The pipeline against the same stages in plain Python, and the queries' shapes."""

import brute
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, texts):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in texts] + [(1000 + i, "BUY!! NOW!! " * (3 + i), "en", "src9", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, *_ in texts if i is not None] + [(1000 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, texts[7][1]), (1, "nothing like this is anywhere in there")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_are_in_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]


def test_pipeline_equals_brute_force(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in good]
    new = brute.dedup_lines([(i, t) for i, t, _ in rows])
    rows = [(i, new[i, t], s) for i, t, s in rows if new[i, t] == t or brute.words(new[i, t])]
    fps = [brute.fingerprint(t) for _, t, _ in rows]
    named = [k for k, r in enumerate(rows) if r[0] is not None]
    comp = brute.reachable([rows[k][0] for k in named], lambda a, b: (fps[named[a]] ^ fps[named[b]]).bit_count() <= 3)
    gone = {k for k, c in zip(named, comp, strict=True) if rows[k][0] != c}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for k, r in enumerate(rows) if k not in gone and not any(brute.contained(r[1], x) for x in items)]
    want = brute.mixed(rows)
    got = corpus_pipeline.run(spark, folder).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted((key(r.doc_id), r.size, round(r.target, 6), r.taken) for r in got) == sorted((key(i), n, round(t, 6), k) for i, n, t, k in want)
    assert 0 < len(got) < docs.count()
    assert sorted((key(r.doc_id), r.text or "") for r in got) == sorted((key(i), t or "") for i, t, _ in rows)


def test_all_but_the_last_stage_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_entry_has_all_fourteen():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_n_chars_follows_the_text(spark, folder):
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 1000"), folder)
    assert out.where(F.coalesce(F.length("text"), F.lit(0)) != F.col("n_chars")).count() == 0
