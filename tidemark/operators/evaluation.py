"""Offline evaluation: precision and ratio gates, recall, ledgers and repeatable samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def top_gates(rows: DataFrame, rank: str, good: Column, bad: Column, double: Column, small: int = 10, large: int = 20) -> DataFrame:
    """Precision of the first `small` rows and ratios of the first `large`; null with fewer rows than that."""
    n = F.count("*")
    share = lambda test, k: F.when(n >= k, F.count_if(test & (F.col(rank) <= k)) / F.lit(float(k)))
    return rows.agg(n.alias("n"), share(good, small).alias("precision_small"), share(bad, large).alias("irrelevant_large"), share(double, large).alias("duplicate_large"))


def ratio(part: Column, whole: Column) -> Column:
    """Null where there is nothing to compare with."""
    return F.try_divide(part, whole)


def recall(expected: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: expected keys, those found, and the share; null without expected ones."""
    hit = found.select(*key).distinct().withColumn("__hit", F.lit(1))
    joined = expected.select(*key).distinct().join(hit, list(key), "left")
    return joined.agg(F.count("*").alias("expected"), F.count("__hit").alias("found")).withColumn("recall", ratio(F.col("found"), F.col("expected")))


def error_ledger(rows: DataFrame, errors: str, item: str, samples: int = 3) -> DataFrame:
    """Per error: distinct items and the first few of them."""
    each = rows.select(item, F.explode(errors).alias("error")).distinct()
    first = each.withColumn("__n", F.row_number().over(W.partitionBy("error").orderBy(item)))
    return first.groupBy("error").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__n") <= samples, F.col(item)))).alias("samples"))


def sample(rows: DataFrame, key: str, seed: str, each: int, stratum: str | None = None, forced: Column | None = None) -> DataFrame:
    """`each` rows of every stratum in the order of a seeded hash of the key, the forced ones first."""
    order = [F.sha1(F.concat(F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    order = [F.desc(forced), *order] if forced is not None else order
    own = W.partitionBy(*([stratum] if stratum else [])).orderBy(*order)
    if not stratum:
        return rows.orderBy(*order).limit(each)
    return rows.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= each).drop("__n")
