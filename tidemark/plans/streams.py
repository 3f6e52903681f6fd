"""Streams over the landed event files, run to the end of what is there; each equals its batch form."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import paging
from ..operators.order import numbered
from ..sources import commits, sinks
from ..streaming import coverage
from . import query, table
from .session import cut, shared_dir


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream, with times as instants."""
    # a pattern, as a stream's path may not be a single file
    return streaming.files(spark, f"{sf_dir}/event[s].parquet", table(spark, sf_dir, "events").schema).withColumn("at", F.col("ts").cast("timestamp"))


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        streaming.drain(stream, "", f"{root}/checkpoint", mode, lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out"))
    else:
        streaming.drain(stream, f"{root}/out", f"{root}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("""SELECT CAST(time_bucket(INTERVAL 1 DAY, ts) AS VARCHAR) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = _drained(streaming.windowed_counts(cents, "at", "event_type", "1 day", "200 days", "cents"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("""SELECT DISTINCT event_id FROM events""")
def stream_redelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return _drained(streaming.once(events.union(events), "event_id", "at", "200 days").select("event_id"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT), event_id) AS n FROM events),
f AS (SELECT user_id, event_type, event_id, n, t AS anchor, true AS kept FROM o WHERE n = 1 UNION ALL
 SELECT o.user_id, o.event_type, o.event_id, o.n, CASE WHEN o.t - f.anchor > 86400 THEN o.t ELSE f.anchor END, o.t - f.anchor > 86400 FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.n = f.n + 1)
SELECT event_id FROM f WHERE kept""")
def stream_anchor_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(streaming.anchored(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "at"), ["user_id", "event_type"], "at", "event_id", "200 days"))


_PAGES, _BUDGET, _CUT = 6, 4, "1998-01-01"
_LISTED = f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day, max(n) OVER () AS most FROM orders JOIN (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) USING (o_orderpriority)),
 p AS (SELECT *, CASE WHEN day <= DATE '{_CUT}' THEN (row_number() OVER (PARTITION BY source, day <= DATE '{_CUT}' ORDER BY day DESC, o_orderkey DESC) - 1) // CAST(ceil(most / {_PAGES}) AS BIGINT) + 1 END AS page FROM o)"""


def _listing(documents: DataFrame, size: int) -> DataFrame:
    """Pages of so many documents for each source, newest first."""
    order = [F.col("source"), F.desc("published"), F.desc("document")]
    placed = numbered(documents, *order)
    first = placed.groupBy("source").agg(F.min("n").alias("first"))
    return placed.join(first, "source").select("source", (F.floor((F.col("n") - F.col("first")) / size) + 1).cast("int").alias("page"), "document", "published")


@query(_LISTED + f""" SELECT o_orderkey, source, CASE WHEN page IS NULL THEN 3 WHEN page <= {_BUDGET} THEN 1 ELSE 2 END AS batch FROM p""")
def resumed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the run that read them: two runs over one listing, each cut short, and one over a longer listing.

    The second run fails between its rows and their marker and is sent again; the third is sent twice.
    """
    root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("document"), F.col("o_orderdate").cast("date").alias("published"))
    size = -(-(documents.groupBy("source").count().agg(F.max("count")).first()[0] or 1) // _PAGES)
    early, late = _listing(documents.where(F.col("published") <= F.lit(_CUT).cast("date")), size), _listing(documents, size)
    schema = "source string, document long, published date, step int"

    def sent(batch: int, listing: DataFrame, fails: bool = False) -> None:
        known, cursors = commits.rows(spark, root, "documents", schema), commits.newest(spark, root, "cursors", paging.CURSORS)
        steps = cut(paging.run_pages(listing, known, cursors, _BUDGET, date(1900, 1, 1)))
        tables = {"documents": paging.new_documents(listing, known, steps), "cursors": paging.moved_cursors(cursors, steps)}
        if fails:
            commits.stage(root, batch, tables)
        else:
            commits.commit(spark, root, batch, tables)

    for batch, listing, fails in ((1, early, False), (2, early, True), (2, early, False), (3, late, False), (3, late, False)):
        sent(batch, listing, fails)
    return commits.rows(spark, root, "documents", schema).select(F.col("document").alias("o_orderkey"), "source", F.col("batch").cast("int").alias("batch"))


_LATE = "30 days"


@query(f"""WITH d AS (SELECT event_type, ts, CASE WHEN user_id % 5 <> 0 THEN 0 ELSE 1 END AS delivery FROM events WHERE dayofyear(ts) % 9 <> 0),
 f AS (SELECT event_type, max(ts) AS last FROM d WHERE delivery = 0 GROUP BY 1),
 c AS (SELECT event_type AS source, min(ts) AS first, max(ts) AS end, count(*) AS rows, count(*) FILTER (delivery = 1 AND ts < last - INTERVAL {_LATE}) AS late FROM d LEFT JOIN f USING (event_type) GROUP BY 1),
 m AS (SELECT source, count(*) AS missing FROM (SELECT source, unnest(generate_series(CAST(first AS DATE), CAST(c.end AS DATE), INTERVAL 1 DAY)) AS day FROM c) s
  WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM d WHERE d.event_type = s.source AND CAST(d.ts AS DATE) = s.day) GROUP BY 1)
 SELECT source, CAST(CAST(first AS DATE) AS VARCHAR) AS covered_start, CAST(CAST(c.end AS DATE) AS VARCHAR) AS covered_end, rows, late, coalesce(missing, 0) AS missing, coalesce(missing, 0) = 0 AND late = 0 AS complete, 2::BIGINT AS batches, (SELECT count(*) FROM d)::BIGINT AS observed FROM c LEFT JOIN m USING (source)""")
def stream_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of event types that land in two deliveries, the second with old rows, and some days never."""
    root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).where(F.dayofyear("ts") % 9 != 0).select("event_id", "user_id", "event_type", "at")
    seen = None
    for n, part in enumerate((F.col("user_id") % 5 != 0, F.col("user_id") % 5 == 0)):
        events.where(part).write.parquet(f"{root}/landed/delivery={n}")
        stream = coverage.observed(streaming.files(spark, f"{root}/landed/delivery=*", events.schema, 10_000), "at")
        ended = streaming.drain(stream, "", f"{root}/checkpoint", sink=coverage.covering(f"{root}/tables", "event_type", "at", _LATE))
        figures = coverage.progress(spark, ended)
        seen = figures if seen is None else seen.union(figures)
    now = commits.newest(spark, f"{root}/tables", "coverage", coverage.COVERAGE)
    missing = coverage.missing_days(now, commits.rows(spark, f"{root}/tables", "days", coverage.DAYS), F.dayofweek("day").between(2, 6))
    totals = seen.where("rows > 0").agg(F.count_distinct("batch").alias("batches"), F.sum("rows").alias("observed"))  # one row
    day = lambda c: F.col(c).cast("date").cast("string").alias(c)
    return coverage.completeness(now, missing).crossJoin(F.broadcast(totals)).select("source", day("covered_start"), day("covered_end"), "rows", "late", "missing", "complete", "batches", "observed")


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) - 90 FROM orders) GROUP BY 1""")
def retained_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last 90 days, from a table whose older days were dropped without reading them."""
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    last = orders.agg(F.max("o_orderdate")).first()[0] or date(1970, 1, 1)
    sinks.write_days(orders.where(F.col("o_orderdate") >= F.lit(last - timedelta(days=400))), F.col("o_orderdate"), path)
    sinks.drop_days(spark, path, last - timedelta(days=90))
    return sinks.read_days(spark, path, last - timedelta(days=90)).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))
