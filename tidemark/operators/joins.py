"""Joins with a twist: overlap of arrays with a time bound, history, as-of with a predicate, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import trigram_cosine
from ..plans.session import cut


def overlap_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, codes: str, left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Distinct (left_id, right_id) of different rows that share a code, the right one at most `seconds` older, none newer.

    Rows meet by code and stretch of time as long as the bound: a right row is in its own stretch and the next, so a
    code that most rows have is spread over time and only close rows are compared. Equal keys go to two plain sides,
    which Spark can split where one is hot.
    """
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    stretch = lambda c: F.floor(second(c) / seconds)
    a = left.select(left_id, left_at, F.explode(F.array_distinct(codes)).alias("__code"), stretch(left_at).alias("__stretch"))
    b = right.select(right_id, right_at, F.explode(F.array_distinct(codes)).alias("__code"), stretch(right_at).alias("__own"))
    b = b.select(right_id, right_at, "__code", F.explode(F.array(F.col("__own"), F.col("__own") + 1)).alias("__stretch"))
    near = a.join(b, ["__code", "__stretch"]).where((F.col(left_id) != F.col(right_id)) & (F.col(right_at) <= F.col(left_at)) & (F.col(right_at) >= F.col(left_at) - F.make_dt_interval(secs=F.lit(seconds))))
    return near.select(left_id, right_id).distinct()


def newest_before(rows: DataFrame, history: DataFrame, key: str, row_id: str, at: str, past_id: str, past_at: str, least: str, most: str) -> DataFrame:
    """(row_id, past_id): the newest earlier row of the same key that is between `least` and `most` (intervals) older.

    Both tables are put in one order of time per key, the rows moved back by `least`; the last past row before each is
    the newest one, and is taken if it isn't too old. No row is joined to the history of its key.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    past = F.struct(F.col(past_at).alias("at"), F.col(past_id).alias("id"))
    asked = rows.where(f"{key} is not null and {at} is not null").select(key, (F.col(at) - F.expr(f"interval {least}")).alias("__at"), F.lit(1).alias("__side"), F.col(row_id), F.col(at), F.struct(none(history, past_at).alias("at"), none(history, past_id).alias("id")).alias("__past"))
    known = history.where(f"{key} is not null and {past_at} is not null").select(key, F.col(past_at).alias("__at"), F.lit(0).alias("__side"), none(rows, row_id).alias(row_id), none(rows, at).alias(at), past.alias("__past"))
    upto = W.partitionBy(key).orderBy("__at", "__side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = known.union(asked).withColumn("__last", F.max(F.when(F.col("__side") == 0, F.col("__past"))).over(upto)).where("__side = 1")
    near = found.where(F.col("__last.at") >= F.col(at) - F.expr(f"interval {most}"))
    return near.groupBy(row_id).agg(F.max("__last").alias("__last")).select(row_id, F.col("__last.id").alias(past_id))


def alike_pairs(names: DataFrame, key: list[str], name: str, grams: str, least: float) -> DataFrame:
    """(key, a, b, cosine) of distinct names of a key whose sets of trigrams have a cosine of at least `least`, a < b.

    Grams are put in one order, the rarest of the key first. Of two such names with n and m >= n grams, at least
    least * n and least**2 * m are common, so the first n - ceil(least * n) + 1 grams of the shorter one and the first
    m - ceil(least**2 * m) + 1 of the other have one in common: only those are joined, where the numbers of grams
    allow the cosine and the places of the common gram leave enough others behind it. A gram that all names hold is
    last in each, so it joins only names that consist of next to nothing else.
    """
    distinct = names.where(F.size(grams) > 0).groupBy(*key, name).agg(F.any_value(grams).alias("__grams"))
    single = distinct.select(*key, name, F.explode("__grams").alias("__gram"))
    held = single.withColumn("__held", F.count("*").over(W.partitionBy(*key, "__gram")))
    rare = cut(held.groupBy(*key, name).agg(F.array_sort(F.collect_list(F.struct("__held", "__gram"))).alias("__g")))
    n, tiny = F.size("__g"), 1e-9
    few = lambda share: (n - F.ceil(n * F.lit(share) - tiny) + 1).cast("int")

    def side(c: str, share: float) -> DataFrame:
        first = rare.select(*key, F.col(name).alias(c), n.alias(f"__n_{c}"), F.posexplode(F.slice("__g", F.lit(1), few(share))).alias(f"__at_{c}", "__x"))
        return first.select(*key, c, f"__n_{c}", f"__at_{c}", F.col("__x.__gram").alias("__gram"))

    shorter = (F.col("__n_a") < F.col("__n_b")) | (F.col("__n_a") == F.col("__n_b")) & (F.col("a") < F.col("b"))
    wanted = F.sqrt(F.col("__n_a").cast("double") * F.col("__n_b")) * least - tiny
    left_over = F.least(F.col("__n_a") - F.col("__at_a"), F.col("__n_b") - F.col("__at_b"))
    pairs = side("a", least).join(side("b", least * least), [*key, "__gram"]).where(shorter & (F.col("__n_a") >= wanted) & (left_over >= wanted))
    met = pairs.select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    whole = lambda c: rare.select(*key, F.col(name).alias(c), F.transform("__g", lambda x: x["__gram"]).alias(f"__{c}"))
    both = met.join(whole("a"), [*key, "a"]).join(whole("b"), [*key, "b"])
    return both.withColumn("cosine", trigram_cosine(F.col("__a"), F.col("__b"))).where(F.col("cosine") >= least - 1e-12).select(*key, "a", "b", "cosine")


def edit_pairs(names: DataFrame, key: list[str], name: str, most: int) -> DataFrame:
    """(key, a, b, distance) of distinct names of a key at most `most` edits apart, a < b.

    The shorter name is cut into most + 1 pieces, one of which no edit touches: it stands in the longer one as well,
    moved by no more than the edits before and behind it allow. So names are joined by length, number and text of a
    piece, some (most + 1)**3 of them for a name of any length, and then the distance is computed.
    """
    distinct = names.where(F.col(name).isNotNull()).select(*key, name).distinct()
    size, parts = F.length(name), most + 1
    start = lambda n, i: i * F.floor(n / parts) + F.greatest(i - (parts - n % parts), F.lit(0))
    width = lambda n, i: start(n, i + 1) - start(n, i)
    text = lambda at, n: F.substring(F.col(name), (at + 1).cast("int"), n.cast("int"))
    numbers = F.sequence(F.lit(0), F.lit(most))
    pieces = F.transform(numbers, lambda i: F.struct(size.cast("int").alias("n"), i.alias("i"), text(start(size, i), width(size, i)).alias("t")))

    def places(n: Column, i: Column) -> Column:
        more = size - n
        low = F.greatest(start(n, i) - i, start(n, i) + more - (most - i), F.lit(0))
        high = F.least(start(n, i) + i, start(n, i) + more + (most - i), size - width(n, i))
        ats = F.when(low <= high, F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(ats, lambda at: F.struct(n.cast("int").alias("n"), i.alias("i"), text(at, width(n, i)).alias("t")))

    lengths = F.sequence(F.greatest(size - most, F.lit(0)), size)
    asked = F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(numbers, lambda i: places(n, i))))))
    side = lambda c, found: distinct.select(*key, F.col(name).alias(c), F.inline(found).alias("__n", "__i", "__t"))
    met = side("a", pieces).join(side("b", asked), [*key, "__n", "__i", "__t"]).where("a <> b")
    met = met.select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.withColumn("distance", F.levenshtein("a", "b", most)).where("distance >= 0")


def first_alias(rows: DataFrame, key: str, tables: list[tuple[DataFrame, str]], fallback: Column, out: str) -> DataFrame:
    """The id of each key from the first table that has it, else the fallback."""
    for i, (table, column) in enumerate(tables):
        rows = rows.join(table.select(key, F.col(column).alias(f"__{i}")).dropDuplicates([key]), key, "left")
    return rows.withColumn(out, F.coalesce(*(F.col(f"__{i}") for i in range(len(tables))), fallback)).drop(*(f"__{i}" for i in range(len(tables))))


def named_only_once(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """Rows without those unnamed where the group has a named one."""
    named = F.max(F.col(name).isNotNull()).over(W.partitionBy(*group))
    return rows.withColumn("__named", named).where(F.col(name).isNotNull() | ~F.col("__named")).drop("__named")


def set_differences(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, common, only_left, only_right) sizes of the two sets of each key, for keys on both sides."""
    a = left.groupBy(key).agg(F.collect_set(value).alias("a"))
    b = right.groupBy(key).agg(F.collect_set(value).alias("b"))
    return a.join(b, key).select(key, F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_except("a", "b")).alias("only_left"), F.size(F.array_except("b", "a")).alias("only_right"))
