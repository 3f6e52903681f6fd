"""The corpus pipeline: good documents, without repeated lines, copies and benchmark passages, mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, mixing, quality, simhash
from tidemark.llm.common import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the text. A document that loses all its words goes."""
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(mixing.WORD))
    size = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", size).select(docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that of the smallest id. Documents without an id stay."""
    groups = simhash.simhash_components(docs.where("doc_id is not null"))
    others = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("copy_id"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text, and how often and how many words the mix takes of it; mixing.emitted() writes the copies."""
    return mixing.mix(docs, with_text=True)


STAGES = [("quality", good), ("line_dedup", lines), ("simhash", copies), ("decontamination", benchmark), ("mixing", mixture)]

#: SQL can't express the discriminant, the fingerprints or the MinHash search; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again. Empty tables give an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
