"""How far each source of a stream is covered: a table of figures kept up with the rows, and what is missing in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import commits

COVERAGE = "source string, covered_start timestamp, covered_end timestamp, cutoff timestamp, rows long, late long"
DAYS = "source string, day date, rows long"
_FIGURES = ("earliest", "latest")


def observed(stream: DataFrame, at: str, name: str = "arrived") -> DataFrame:
    """The stream, with the rows of each batch and their first and last time among its progress figures."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.min(at).cast("string").alias("earliest"), F.max(at).cast("string").alias("latest"))


def progress(spark: SparkSession, query: StreamingQuery, name: str = "arrived") -> DataFrame:
    """(batch, rows, earliest, latest, watermark): the figures of a query's latest batches, one row each."""
    rows = []
    for p in query.recentProgress:
        seen = p.observedMetrics.get(name)
        if seen is not None:
            rows.append((p.batchId, seen["rows"], *(seen[c] for c in _FIGURES), p.eventTime.get("watermark")))
    return spark.createDataFrame(rows, "batch long, rows long, earliest string, latest string, watermark string")


def covered(before: DataFrame, rows: DataFrame, source: str, at: str, delay: str) -> DataFrame:
    """COVERAGE after a batch: the span of all rows so far, the cutoff that much before its end, and how many rows came
    behind the cutoff there was before them. Rows without a source or time are left out."""
    cutoffs = before.select(F.col("source").alias(source), "cutoff")
    own = rows.where(F.col(source).isNotNull() & F.col(at).isNotNull()).select(F.col(source).cast("string").alias(source), F.col(at).cast("timestamp").alias("__at")).join(cutoffs, source, "left")
    now = own.groupBy(F.col(source).alias("source")).agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n"), F.count_if(F.coalesce(F.col("__at") < F.col("cutoff"), F.lit(False))).alias("behind"))
    both = before.join(now, "source", "full")
    end = F.greatest("covered_end", "last")
    none = F.lit(0).cast("long")
    sum_of = lambda a, b: F.coalesce(a, none) + F.coalesce(b, none)
    return both.select("source", F.least("covered_start", "first").alias("covered_start"), end.alias("covered_end"), (end - F.expr(f"interval {delay}")).alias("cutoff"), sum_of("rows", "n").alias("rows"), sum_of("late", "behind").alias("late"))


def covering(root: str, source: str, at: str, delay: str) -> Callable[[DataFrame, int], None]:
    """A sink of batches that keeps the tables coverage and days under root, in one commit with the batch's rows.

    A batch that is sent again after a failure is counted once.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number in commits.batches(spark, root):
            return
        batch = batch.persist()
        days = batch.where(F.col(source).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(source).cast("string").alias("source"), F.col(at).cast("date").alias("day")).agg(F.count("*").alias("rows"))
        after = covered(commits.newest(spark, root, "coverage", COVERAGE), batch, source, at, delay)
        commits.commit(spark, root, number, {"coverage": after, "days": days, "rows": batch})
        batch.unpersist()

    return sink


def missing_days(coverage: DataFrame, days: DataFrame, expected: Column) -> DataFrame:
    """(source, day): expected days of a source's span without rows. expected tells of the column day if rows are due.

    A source has one row for each day, so this grows with time and not with rows.
    """
    due = coverage.select("source", F.explode(F.sequence(F.col("covered_start").cast("date"), F.col("covered_end").cast("date"))).alias("day")).where(expected)
    return due.join(days.select("source", "day").distinct(), ["source", "day"], "left_anti")


def completeness(coverage: DataFrame, missing: DataFrame) -> DataFrame:
    """coverage with the number of days missing, and whether a source is complete: nothing missing, nothing late."""
    n = missing.groupBy("source").agg(F.count("*").alias("missing"))
    out = coverage.join(n, "source", "left").withColumn("missing", F.coalesce("missing", F.lit(0).cast("long")))
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("late") == 0))
