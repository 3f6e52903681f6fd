"""Trading-calendar buckets and the statistics on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.dates import iso_week


def weekdays(bounds: DataFrame, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """The trading days from start to end of a one-row frame: Monday to Friday without holidays (column day)."""
    days = bounds.select(F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    return days.join(holidays.select("day"), "day", "left_anti") if holidays is not None else days


def last_days(days: DataFrame, n: int, end: str | None = None, lookback: int = 730) -> DataFrame:
    """The most recent n trading days up to end, at most `lookback` calendar days back."""
    if end is not None:
        days = days.where(F.col("day").between(F.date_sub(F.lit(end).cast("date"), lookback), F.lit(end).cast("date")))
    return days.orderBy(F.desc("day")).limit(n)


def trading_buckets(days: DataFrame, size: int = 20, complete: bool = False, most: int | None = None) -> DataFrame:
    """(bucket, start, end, n): runs of `size` days from the end, bucket 0 the current one; the oldest may be partial."""
    numbered = days.select("day", F.floor((F.row_number().over(W.orderBy(F.desc("day"))) - 1) / size).cast("int").alias("bucket"))
    out = numbered.groupBy("bucket").agg(F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("n"))
    out = out.where(F.col("n") == size) if complete else out
    return out.where(F.col("bucket") < most) if most is not None else out


def breadth(activity: DataFrame, buckets: DataFrame, key: str, group: str, day: str) -> DataFrame:
    """Distinct groups of each key in each bucket. The calendar is small: it has one row for each bucket."""
    joined = activity.join(F.broadcast(buckets.select("bucket", "start", "end")), F.col(day).between(F.col("start"), F.col("end")))
    return joined.groupBy(key, "bucket").agg(F.count_distinct(group).alias("groups"))


def dense_counts(counts: DataFrame, key: str, buckets: Sequence[int], value: str = "groups") -> DataFrame:
    """(key, current, history): the count in bucket 0 and those of the other buckets, 0 where there is none."""
    per = counts.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col("bucket") == b, F.col(value))), F.lit(0)).alias(f"b{b}") for b in buckets))
    return per.select(key, F.col("b0").alias("current"), F.array(*(F.col(f"b{b}") for b in buckets if b)).alias("history"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _squares(xs: Column, mean: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))


def z20(current: Column, history: Column) -> Column:
    """(current - mean) / max(population deviation, 1); the deviation of fewer than two counts is 0."""
    mean = F.when(F.size(history) > 0, _mean(history)).otherwise(0.0)
    deviation = F.when(F.size(history) >= 2, F.sqrt(_squares(history, mean) / F.size(history))).otherwise(0.0)
    return (current - mean) / F.greatest(deviation, F.lit(1.0))


def warming(current: Column, history: Column, least: int = 5) -> Column:
    """struct<score, mean, variance, predictive, change>, all null below `least` history buckets."""
    n, mean = F.size(history), _mean(history)
    variance = _squares(history, mean) / (n - 1)
    predictive = F.greatest(mean, variance, F.lit(1.0)) * (1.0 + 1.0 / n)
    return F.when(n >= least, F.struct(((current - mean) / F.sqrt(predictive)).alias("score"), mean.alias("mean"), variance.alias("variance"), predictive.alias("predictive"), (current - mean).alias("change")))


def coverage_level(history: Column, formal: Column, comparable: Column) -> Column:
    """full with 12 buckets and a formal ranking, provisional with 5, else raw_only."""
    return F.when(comparable & formal & (F.size(history) == 12), "full").when(comparable & (F.size(history) >= 5), "provisional").otherwise("raw_only")


def new_groups(activity: DataFrame, key: str, group: str, baseline: int = 5) -> DataFrame:
    """Groups of bucket 0 that are in none of the `baseline` buckets before it. activity has a bucket column."""
    now = activity.where("bucket = 0").select(key, group).distinct()
    before = activity.where(F.col("bucket").between(1, baseline)).select(key, group).distinct()
    return now.join(before, [key, group], "left_anti").groupBy(key).agg(F.count("*").alias("new_groups"))


def persistence(activity: DataFrame, days: DataFrame, key: str, group: str, day: str) -> DataFrame:
    """Active weeks and their share, groups, share of groups seen on two days, share of the busiest day.

    Groups count in full even if they have no day in the window; days outside the window don't count.
    """
    weeks = days.select(iso_week(F.col("day")).alias("w")).distinct().agg(F.count("*").alias("total_weeks"))
    groups = activity.groupBy(key).agg(F.count_distinct(group).alias("unique_groups"), F.max(day).alias("recent"))
    inside = activity.select(key, group, F.col(day).alias("day")).join(F.broadcast(days), "day").distinct()
    active = inside.groupBy(key).agg(F.count_distinct(iso_week(F.col("day"))).alias("active_weeks"))
    repeated = inside.groupBy(key, group).agg(F.count("*").alias("n")).groupBy(key).agg(F.count_if(F.col("n") >= 2).alias("repeated"))
    daily = inside.groupBy(key, "day").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("busiest"), F.sum("n").alias("pairs"))
    all_of = groups.join(active, key, "left").join(repeated, key, "left").join(daily, key, "left").crossJoin(F.broadcast(weeks))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return all_of.select(key, F.coalesce("active_weeks", F.lit(0)).alias("active_weeks"), share("active_weeks", "total_weeks").alias("active_week_ratio"), "unique_groups", share("repeated", "unique_groups").alias("repeat_ratio"), share("busiest", "pairs").alias("concentration"), "recent")


def depth_score(low: Column, medium: Column, high: Column, questions: Column) -> Column:
    """Weighted depth per question; null without questions (no evidence isn't zero)."""
    return F.try_divide(0.25 * low + 0.6 * medium + 1.0 * high, questions)


def persistence_score(weeks: Column, repeat: Column, depth: Column, concentration: Column) -> Column:
    return 100.0 * (0.40 * weeks + 0.25 * repeat + 0.20 * depth + 0.15 * (1.0 - concentration))


def rule_index(score: Column, groups: Column, dates_complete: Column, status: Column, depth: Column) -> Column:
    """The score, or null where the evidence it needs is not there."""
    return F.when((groups > 0) & dates_complete & (status == "available") & depth.isNotNull(), score)


def evidence_status(rows: DataFrame, key: str, status: str, complete: str) -> DataFrame:
    """Per key: available, partial_missing or missing_body over all statuses; whether all date mappings are complete."""
    missing, any_there = F.count_if(F.col(status) == "missing_body"), F.count_if(F.col(status) != "missing_body")
    return rows.groupBy(key).agg(F.when(missing == 0, "available").when(any_there > 0, "partial_missing").otherwise("missing_body").alias("status"), F.bool_and(complete).alias("dates_complete"))


def structural_change(activity: DataFrame, key: str, group: str, kind: str, period: str) -> DataFrame:
    """New and lost groups between the rows of period 'prior' and 'recent'."""
    sets = activity.groupBy(key).agg(*(F.collect_set(F.when(F.col(period) == p, F.col(group))).alias(p) for p in ("prior", "recent")))
    return sets.select(key, F.array_sort(F.array_except("recent", "prior")).alias("new_groups"), F.array_sort(F.array_except("prior", "recent")).alias("lost_groups"))


def share_changes(activity: DataFrame, key: str, kind: str, period: str, weight: Column | None = None) -> DataFrame:
    """Change of each kind's share of a key from 'prior' to 'recent'; a share counts as 0 where the kind is missing."""
    one = weight if weight is not None else F.lit(1)
    counts = activity.groupBy(key, kind).agg(*(F.sum(F.when(F.col(period) == p, one).otherwise(0)).alias(p) for p in ("prior", "recent")))
    totals = W.partitionBy(key)
    share = lambda p: F.coalesce(F.try_divide(F.col(p), F.sum(p).over(totals)), F.lit(0.0))
    return counts.select(key, kind, (share("recent") - share("prior")).alias("change"))


def merge_counts(rows: DataFrame, key: str, counts: str) -> DataFrame:
    """The sums of a map column per key and map key: (key, name, total)."""
    return rows.select(key, F.explode(counts).alias("name", "n")).groupBy(key, "name").agg(F.sum("n").alias("total"))
