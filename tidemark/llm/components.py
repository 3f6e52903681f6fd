"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MOST_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another node; component is the smallest node reachable.

    Every round shortens paths: a large star ties each larger neighbour of a node to the smallest one, a small star
    does so with the smaller neighbours. Edges never become more. Null ends and loops are left out; an empty table
    of edges gives an empty table. The minima are aggregated before the shuffle, and the joins have two shuffled
    sides, so Spark can split a hot node.
    """
    one, two = F.col(a).cast("long"), F.col(b).cast("long")
    now = cut(edges.select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).where(one.isNotNull() & two.isNotNull() & (one != two)).distinct())
    before = _signature(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
