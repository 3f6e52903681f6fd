"""Evaluation gates on labels and benchmark-like keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boards as B
from ..operators import evaluation as E
from . import query, table


@query("""WITH r AS (SELECT l.*, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM labels l JOIN documents USING (doc_id) QUALIFY k <= 20)
SELECT count(*) AS n, CASE WHEN count(*) >= 10 THEN count(*) FILTER (k <= 10 AND quality = 1) / 10.0::DOUBLE END AS precision_small, CASE WHEN count(*) >= 20 THEN count(*) FILTER (k <= 20 AND quality = 0) / 20.0::DOUBLE END AS irrelevant_large, CASE WHEN count(*) >= 20 THEN count(*) FILTER (k <= 20 AND toxic = 1) / 20.0::DOUBLE END AS duplicate_large FROM r""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    top = B.ranked(rows, [F.desc("n_chars"), F.asc("doc_id")], rank="k", top=20)
    return E.top_gates(top, "k", F.col("quality") == 1, F.col("quality") == 0, F.col("toxic") == 1)


@query("""SELECT count(*) AS expected, count(f.doc_id) AS found, count(f.doc_id) / CAST(count(*) AS DOUBLE) AS recall FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) e LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE contains(text, 'idiot')) f USING (doc_id)""")
def recall_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.recall(table(spark, sf_dir, "labels").where("toxic = 1"), table(spark, sf_dir, "documents").where(F.contains("text", F.lit("idiot"))), ["doc_id"])


@query("""WITH e AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS error FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY error ORDER BY doc_id) AS k FROM e)
SELECT error, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (k <= 3) AS samples FROM r GROUP BY error""")
def error_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.when(F.col("n_chars") < 500, "short"), F.when(F.contains("text", F.lit(" | ")), "table"), F.when(F.col("lang") != "en", "foreign"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(kinds, lambda x: x.isNotNull()).alias("errors"))
    return E.error_ledger(rows, "errors", "doc_id").withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id % 97 = 0 DESC, sha1('s1' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 5""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return E.sample(docs, "doc_id", "s1", 5, "source", F.col("doc_id") % 97 == 0)


@query("""SELECT source, count(*) AS total, count(*) FILTER (quality = 0) AS excluded, count(*) FILTER (quality = 0) / CAST(nullif(count(quality), 0) AS DOUBLE) AS pollution FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def pollution_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bad = F.count_if(F.col("quality") == 0)
    return rows.groupBy("source").agg(F.count("*").alias("total"), bad.alias("excluded"), E.ratio(bad, F.count("quality")).alias("pollution"))
