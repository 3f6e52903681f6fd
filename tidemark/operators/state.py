"""Coverage, manifests, queues, publishing and retention: state as tables with explicit keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import set_digest


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version for each key; a new row wins a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = W.partitionBy(*key).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old and the rows of new whose key is not there yet: the first writer wins."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti"))


def conditional_enqueue(old: DataFrame, new: DataFrame, key: str, status: str, enqueued: str, pending: str = "pending_attachment") -> DataFrame:
    """(key, status, enqueued): the earlier enqueue time while pending, else null."""
    before = old.select(key, F.col(enqueued).alias("__before"))
    now = new.select(key, status, enqueued).join(before, key, "left")
    return now.select(key, status, F.when(F.col(status) == pending, F.coalesce("__before", enqueued)).alias(enqueued))


def published(rows: DataFrame, marker: DataFrame, batch: str, marked: str) -> DataFrame:
    """The rows of the batch that a one-row marker names; without a marker none."""
    return rows.join(F.broadcast(marker.select(F.col(marked).alias("__marked")).limit(1)), F.col(batch) == F.col("__marked"), "left_semi")


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def broken_references(parts: dict[str, DataFrame], head: DataFrame, key: str) -> DataFrame:
    """(part, key) of rows that name no row of head: a bundle is only published if this is empty."""
    out = None
    for name, part in parts.items():
        bad = part.select(key).distinct().join(head.select(key), key, "left_anti").select(F.lit(name).alias("part"), key)
        out = bad if out is None else out.union(bad)
    return out


def queue_stats(rows: DataFrame, source: str, status: str, at: str, pending: str) -> DataFrame:
    """Per source: rows, those pending, and the earliest pending time."""
    waiting = F.col(status) == pending
    return rows.groupBy(source).agg(F.count("*").alias("total"), F.count_if(waiting).alias("pending"), F.min(F.when(waiting, F.col(at))).alias("oldest_pending"))


def round_robin(rows: DataFrame, bucket: str, order: Sequence[Column], budget: int) -> DataFrame:
    """The first `budget` rows taken in turn from the buckets, with their turn. Only that many of a bucket are numbered."""
    own = W.partitionBy(bucket).orderBy(*order)
    picked = rows.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= budget)
    return picked.orderBy("turn", bucket).limit(budget)


def budget_share(index: Column, sources: Column, budget: Column) -> Column:
    """The budget split evenly, the remainder to the first sources (index from 0)."""
    return F.floor(budget / sources) + (index < budget % sources).cast("int")


def sticky_members(now: DataFrame, before: DataFrame, key: Sequence[str], stable: str) -> DataFrame:
    """Members are those that were and those that are stable now; a former member that isn't stable stays and fails."""
    was = before.select(*key).distinct().withColumn("__was", F.lit(True))
    both = now.select(*key, stable).join(was, list(key), "full").withColumns({stable: F.coalesce(stable, F.lit(False)), "__was": F.coalesce("__was", F.lit(False))})
    return both.where(F.col("__was") | F.col(stable)).select(*key, (~F.col(stable)).alias("failing"))


def failure_intervals(log: DataFrame, key: str, at: str, ok: str) -> DataFrame:
    """(key, opened, closed, failures): runs of failures; closed is the next success, null while open."""
    order = W.partitionBy(key).orderBy(at)
    runs = log.withColumn("__run", F.sum(F.col(ok).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    after = log.withColumn("__run", F.sum(F.col(ok).cast("int")).over(order) - 1).where(F.col(ok)).select(key, "__run", F.col(at).alias("closed"))
    bad = runs.where(~F.col(ok)).groupBy(key, "__run").agg(F.min(at).alias("opened"), F.count("*").alias("failures"))
    return bad.join(after, [key, "__run"], "left").select(key, "opened", "closed", "failures")


def manifest(rows: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Per day and source: local count and digest of the distinct items."""
    return rows.groupBy(*keys).agg(F.count_distinct(item).alias("local_count"), set_digest(F.collect_set(F.col(item).cast("string"))).alias("digest"))


def reconcile(manifests: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifests with the total stated by the source and whether both agree."""
    return manifests.join(totals, list(keys), "left").withColumn("reconciled", F.coalesce(F.col("total_count") == F.col("local_count"), F.lit(False)))


def common_window(rows: DataFrame, key: str, start: str, end: str, hull: bool = False) -> DataFrame:
    """The sources' common window, or with hull the one that holds all."""
    low, high = (F.min, F.max) if hull else (F.max, F.min)
    return rows.groupBy(key).agg(low(start).alias("start"), high(end).alias("end"))


def active_clusters(clusters: DataFrame, last_seen: str, start: Column, end: Column) -> DataFrame:
    """Clusters seen in the window; those seen at exact midnight count by their date."""
    seen = F.col(last_seen)
    midnight = seen == F.date_trunc("day", seen.cast("timestamp")).cast("timestamp_ntz")
    return clusters.where((seen <= end) & ((seen >= start) | midnight & (seen.cast("date") >= start.cast("date"))))
