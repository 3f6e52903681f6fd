"""Numbers of all rows in an order, and sums up to each, without putting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import cut

PART, BEFORE, ONE = "__tidemark_part", "__tidemark_before", "__tidemark_one"
#: Rows up to which one task numbers them all: fewer than a range is worth.
ONE_TASK = 100_000


def running_total(df: DataFrame, *order: Column, amount: str, name: str, one_task: int = ONE_TASK) -> DataFrame:
    """df with the sum of an amount over all rows up to each in an order; equal rows are taken in any order.

    df is computed once, and counted. Up to one_task rows are summed in one task; more are cut into ranges, summed
    within each and moved up by the sums of the ranges before: one sum for each range is all that is collected. Equal
    rows are in one range.
    """
    upto = (W.unboundedPreceding, W.currentRow)
    once = cut(df)
    if once.count() <= one_task:
        return once.withColumn(name, F.sum(amount).over(W.orderBy(*order).rowsBetween(*upto)))
    ranged = cut(once.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))
    total, before = 0, []
    for r in ranged.groupBy(PART).agg(F.sum(amount).alias("sum")).orderBy(PART).collect():
        before.append((r[PART], total))
        total += r["sum"] or 0
    sums = df.sparkSession.createDataFrame(before, f"{PART} int, {BEFORE} {ranged.schema[amount].dataType.simpleString()}")
    own = F.sum(amount).over(W.partitionBy(PART).orderBy(*order).rowsBetween(*upto))
    # one row for each range, of which there are as many as shuffle partitions
    return ranged.join(F.broadcast(sums), PART).withColumn(name, own + F.col(BEFORE)).drop(PART, BEFORE)


def numbered(df: DataFrame, *order: Column, name: str = "n", one_task: int = ONE_TASK) -> DataFrame:
    """df with its rows numbered from 1 in an order; among equal rows the numbers are any."""
    return running_total(df.withColumn(ONE, F.lit(1).cast("long")), *order, amount=ONE, name=name, one_task=one_task).drop(ONE)
