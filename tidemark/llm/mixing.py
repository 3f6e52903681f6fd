"""Mixing sources to target weights: per-source repetition rates, then whole copies and one seeded extra copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.places import listed
from ..operators.order import numbered
from .common import cut

WORD = listed(" ", "\t-\r", other=True) + "+"
#: A source is repeated at most so often.
MOST = 3
SEED = "mix-1"
#: Up to so many sources (under 100 bytes each) their rates are worked out in one task and broadcast; with more they
#: are numbered in ranges, levelled by sums, and joined by shuffle.
BROADCAST_SOURCES = 50_000


def _levelled(per: DataFrame, most: int) -> DataFrame:
    """The rates of any number of sources. Sources that are full at a level stay full at the next, which is higher."""
    weighed = cut(numbered(per, F.col("source").asc_nulls_last(), name="n").withColumn("weight", (F.col("n") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most))
    size, full, level = weighed.agg(F.sum("source_size")).first()[0], -1, None
    while True:
        above = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        r = weighed.agg(F.count(F.when(above, 1)).alias("full"), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if r.full == full or not r.weight:
            break
        full, level = r.full, (size - r.cap) / r.weight
    return weighed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def source_rates(sizes: DataFrame, most: int = MOST, in_one_task: int = BROADCAST_SOURCES) -> DataFrame:
    """(source, source_size, target) for rows of (source, size).

    The sources, by code point and null last, weigh 1, 2, 3 and so on in turn. Together they get all sizes; a target
    above `most` times its source's size stops there and the excess goes to the others by weight, until none is above.
    That end point is min(cap, level * weight) for one level: with sources in order of cap / weight, it is the level
    left for all others once those before are full, at the first source that doesn't fill up at it.
    """
    per = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    if per.count() > in_one_task:
        return _levelled(per, most)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighed = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    others = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", left.cast("double") / others)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.row_number().over(order))
    chosen = level.withColumn("at", fits).withColumn("level", F.min_by("level", "at").over(all_rows))
    return chosen.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def uniform(key: F.Column, seed: str = SEED) -> F.Column:
    """A number in [0, 1) from the first 8 hex digits of an MD5: the same for the same key and seed, on any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, most: int, seed: str, *more: F.Column) -> DataFrame:
    """(id, size, source_size, target, copies) of every row of docs, and more columns of it."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *more)
    if not more:  # small rows: words are counted once; texts are read again rather than written
        rows = cut(rows)
    rates = cut(source_rates(rows.select("source", "size"), most))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = rows.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).drop("source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = uniform(F.col("id"), seed) < F.col("rate") - F.floor("rate")
    return joined.withColumn("rate", rate).withColumn("copies", F.floor("rate") + extra.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: str = SEED, with_text: bool = False) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) of every row of docs, and its text_col if asked for.

    A row is taken floor(rate) times, and once more if its id's hash falls below the rate's fraction. Null texts and
    texts without words have size 0 and take 0 words. A null source is a source of its own. Rows that share an id share
    the decision on the extra copy. An empty table gives an empty table. Other columns are not read.
    """
    more = [F.col(text_col).alias("__text")] if with_text else []
    out = _counted(docs, id_col, text_col, source_col, most, seed, *more)
    shown = [F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return out.select(*shown, *([F.col("__text").alias(text_col)] if with_text else []))


def emitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, seed: str = SEED, copy: str = "copy") -> DataFrame:
    """The mixed corpus: each row of docs as often as mix() takes it, with a column of the copy's number from 1.

    Rows that are not taken are left out. A column of docs that has the name of the copy column is replaced.
    """
    out = _counted(docs, id_col, text_col, source_col, most, seed, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != copy)).alias("__row"))
    taken = out.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"))
    return taken.select("__row.*", F.col("__copy").alias(copy))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS pos,
    (CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), chosen AS (
  SELECT level FROM ordered WHERE level <= cap / weight ORDER BY pos LIMIT 1
), rates AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM chosen) * weight) AS target FROM ordered
), each AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM each
"""
