"""Ranked boards: counts per key, total orders, and blended heat."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .order import ONE_TASK, numbered, running_total


def ranked(rows: DataFrame, order: Sequence[Column], rank: str = "rank", top: int | None = None) -> DataFrame:
    """Rows with their place in a total order, numbered by ranges. With top, only those first rows reach one task."""
    if top is not None:
        return rows.orderBy(*order).limit(top).withColumn(rank, F.row_number().over(W.orderBy(*order)))
    return numbered(rows, *order, name=rank).withColumn(rank, F.col(rank).cast("int"))


def mention_heat(mentions: DataFrame, key: str, event: str, article: str, at: str) -> DataFrame:
    """Per key: distinct events, mentions, last time; most events first, then the latest, then the key."""
    per = mentions.groupBy(key).agg(F.count_distinct(event).alias("event_count"), F.count(article).alias("raw_count"), F.max(at).alias("latest"))
    return ranked(per, [F.desc("event_count"), F.desc("latest"), F.asc(key)])


def event_tags(events: DataFrame, key: str, event: str, tag: str) -> DataFrame:
    """Per key all tags of its events, also those of articles that don't name the key."""
    keys, tags = events.select(key, event).distinct(), events.select(event, tag).where(F.col(tag).isNotNull()).distinct()
    return keys.join(tags, event).groupBy(key).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def value_ranks(rows: DataFrame, value: str, partition: Sequence[str] = (), one_task: int = ONE_TASK) -> DataFrame:
    """rows with __below, __equal and __all: how many of the partition are below a row, as high, and there at all.

    Rows of a value are counted first. The counts are summed up in one order of partition and value, in ranges, and
    joined back by value; so neither a partition nor all rows need fit in a task. Nulls are the lowest value.
    """
    by = list(partition)
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("__equal"))
    summed = running_total(counts, *(F.col(c).asc_nulls_first() for c in (*by, value)), amount="__equal", name="__upto", one_task=one_task)
    summed = summed.withColumn("__upto", F.col("__upto") - F.col("__equal"))
    parts = summed.groupBy(*by).agg(F.min("__upto").alias("__from"), F.sum("__equal").alias("__all"))
    same = lambda other, keys: reduce(and_, (F.col(f"__{c}").eqNullSafe(other[c]) for c in keys), F.lit(True))
    named = lambda df, keys: df.withColumnsRenamed({c: f"__{c}" for c in keys})
    # one row without partition columns
    ranked_values = summed.join(named(parts, by), same(summed, by)).drop(*(f"__{c}" for c in by)) if by else summed.crossJoin(F.broadcast(parts))
    ranks = named(ranked_values.withColumn("__below", F.col("__upto") - F.col("__from")).drop("__upto", "__from"), [*by, value])
    return rows.join(ranks, same(rows, [*by, value])).drop(*(f"__{c}" for c in (*by, value)))


def _average_rank(below: Column, equal: Column, n: Column) -> Column:
    return F.when(n == 1, 100.0).otherwise((below + 1 + (equal - 1) / 2.0 - 1) / (n - 1) * 100.0)


def average_rank_percentiles(rows: DataFrame, value: str, partition: Sequence[str] = (), out: str = "percentile", one_task: int = ONE_TASK) -> DataFrame:
    """rows with (average rank - 1) / (n - 1) * 100 within the partition; 100 for a single row."""
    ranks = value_ranks(rows, value, partition, one_task)
    return ranks.withColumn(out, _average_rank(F.col("__below"), F.col("__equal"), F.col("__all"))).drop("__below", "__equal", "__all")


def midrank_percentiles(rows: DataFrame, value: str, partition: Sequence[str], least: int, out: str = "percentile", one_task: int = ONE_TASK) -> DataFrame:
    """rows with (rows below + half of those equal) / n * 100 within the partition; null below `least` rows."""
    ranks = value_ranks(rows, value, partition, one_task)
    share = F.when(F.col("__all") >= least, (F.col("__below") + 0.5 * F.col("__equal")) / F.col("__all") * 100.0)
    return ranks.withColumn(out, share).drop("__below", "__equal", "__all")


def average_rank_percentile(value: str, partition: Sequence[str] = ()) -> Column:
    """The average-rank percentile as a window, for partitions that fit in a task."""
    by, own = W.partitionBy(*partition), W.partitionBy(*partition, value)
    return _average_rank(F.rank().over(by.orderBy(value)) - 1, F.count(F.lit(1)).over(own), F.count(F.lit(1)).over(by))


def midrank_percentile(value: str, partition: Sequence[str], least: int) -> Column:
    """The midrank percentile as a window, for partitions that fit in a task."""
    by, own = W.partitionBy(*partition), W.partitionBy(*partition, value)
    n = F.count(F.lit(1)).over(by)
    return F.when(n >= least, (F.rank().over(by.orderBy(value)) - 1 + 0.5 * F.count(F.lit(1)).over(own)) / n * 100.0)


def industry_heat(popular: DataFrame, articles: DataFrame, industry: str, code: str, article: str) -> DataFrame:
    """Popular codes (a) and articles (b) per industry, blended half and half by percentile; only industries with a.

    Industries are a fixed list of some hundred at most, so that their percentiles and ranks need one task only.
    """
    a = popular.groupBy(industry).agg(F.count_distinct(code).alias("a"))
    b = articles.groupBy(industry).agg(F.count_distinct(article).alias("b"))
    both = a.join(b, industry, "left").withColumn("b", F.coalesce("b", F.lit(0))).withColumn("log_b", F.log1p("b"))
    blended = both.withColumns({"a_percentile": average_rank_percentile("a"), "b_percentile": average_rank_percentile("log_b")})
    blended = blended.withColumn("heat", 0.5 * F.col("a_percentile") + 0.5 * F.col("b_percentile"))
    order = W.orderBy(F.desc("heat"), F.desc("a"), F.desc("b"), F.asc(industry))
    return blended.withColumn("rank", F.row_number().over(order)).drop("log_b")


def attribution(tags: Column, concepts: Column, by_stock: Column, aliases: Column) -> Column:
    """struct<industries, path>: explicit tags, else concepts, else the stocks' industries. Unknown tags don't fall back."""
    mapped = lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda x: aliases[x]), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    tags, concepts, by_stock = (F.coalesce(x, none) for x in (tags, concepts, by_stock))
    out = lambda xs, path: F.struct(xs.alias("industries"), F.lit(path).alias("path"))
    return (
        F.when((F.size(tags) > 0) & (F.size(mapped(tags)) > 0), out(mapped(tags), "explicit"))
        .when(F.size(tags) > 0, out(none, "unknown_label"))
        .when(F.size(mapped(concepts)) > 0, out(mapped(concepts), "concept"))
        .when(F.size(mapped(by_stock)) > 0, out(F.array_sort(mapped(by_stock)), "stock"))
        .when(F.size(by_stock) > 0, out(none, "stock_unmapped"))
        .when(F.size(concepts) > 0, out(none, "unknown_concept"))
        .otherwise(out(none, "no_evidence"))
    )


def path_counts(rows: DataFrame, path: str = "path") -> DataFrame:
    """One row with the number of rows on each attribution path, in one pass."""
    kinds = ("explicit", "concept", "stock", "unknown_label", "unknown_concept", "no_evidence", "stock_unmapped")
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(path) == k).alias(k) for k in kinds))


def facet_filter(rows: DataFrame, query: str = "", query_columns: Sequence[str] = (), facets: dict[str, Sequence[str]] | None = None, untagged: str = "未标注") -> DataFrame:
    """Rows whose columns hold the query in lower case and whose tags meet each facet's choice; no tags count as untagged."""
    if query:
        test = F.lit(False)
        for c in query_columns:
            test = test | F.contains(F.lower(F.col(c).cast("string")), F.lit(query.lower()))
        rows = rows.where(test)
    for column, chosen in (facets or {}).items():
        own = F.when(F.size(column) > 0, F.col(column)).otherwise(F.array(F.lit(untagged)))
        rows = rows.where(F.arrays_overlap(own, F.array(*map(F.lit, chosen)))) if chosen else rows
    return rows


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: the latest batch, the newest manifest, the first writer."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def ordered_union(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """All rows of the frames, for each key those of the first frame that has it."""
    both = None
    for i, frame in enumerate(frames):
        frame = frame.withColumn("__from", F.lit(i))
        both = frame if both is None else both.unionByName(frame)
    return first_per_key(both, key, [F.asc("__from")]).drop("__from")


def name_lookup(codes: DataFrame, key: str, sources: Sequence[tuple[DataFrame, str]], out: str = "name") -> DataFrame:
    """The name of each key from the last source that has one; else the key itself."""
    names = None
    for i, (frame, column) in enumerate(sources):
        part = frame.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("n")).withColumn("p", F.lit(i))
        names = part if names is None else names.union(part)
    best = names.groupBy(key).agg(F.max_by("n", "p").alias(out))
    return codes.join(best, key, "left").withColumn(out, F.coalesce(out, F.col(key).cast("string")))
