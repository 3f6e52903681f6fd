"""Trading-day buckets and window statistics on line items and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import iso_week, timeliness
from ..operators import metrics as M
from . import query, table

_DAYS = """WITH b AS (SELECT CAST(min(l_shipdate) AS DATE) AS s, CAST(max(l_shipdate) AS DATE) AS e FROM lineitem),
d AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM b), days AS (SELECT day FROM d WHERE isodow(day) <= 5)"""
_BUCKETS = _DAYS + """, nb AS (SELECT day, CAST(floor((row_number() OVER (ORDER BY day DESC) - 1) / 20) AS INTEGER) AS bucket FROM days),
buckets AS (SELECT bucket, min(day) AS start, max(day) AS end, count(*) AS n FROM nb GROUP BY bucket)"""
_COUNTS = _BUCKETS + """, act AS (SELECT DISTINCT l_suppkey, bucket, l_partkey FROM lineitem JOIN buckets ON CAST(l_shipdate AS DATE) BETWEEN start AND "end" WHERE n = 20 AND bucket <= 12),
cnt AS (SELECT l_suppkey, bucket, count(*) AS groups FROM act GROUP BY 1, 2),
keys AS (SELECT DISTINCT l_suppkey FROM act), grid AS (SELECT k.l_suppkey, i.bucket, coalesce(c.groups, 0) AS groups FROM keys k CROSS JOIN (SELECT unnest(range(0, 13)) AS bucket) i LEFT JOIN cnt c ON c.l_suppkey = k.l_suppkey AND c.bucket = i.bucket)"""


def _shown(rows: DataFrame, *dates: str) -> DataFrame:
    return rows.withColumns({d: F.col(d).cast("string") for d in dates})


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    return M.weekdays(bounds, "s", "e")


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_shipdate").cast("date").alias("on"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = M.trading_buckets(_days(spark, sf_dir), 20, complete=True, most=13)
    return M.dense_counts(M.breadth(_activity(spark, sf_dir), buckets, "l_suppkey", "l_partkey", "on"), "l_suppkey", range(13))


@query(_BUCKETS + ' SELECT bucket, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", n FROM buckets')
def trading_buckets_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.trading_buckets(_days(spark, sf_dir)), "start", "end")


@query(_BUCKETS + ' SELECT bucket, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", n FROM buckets WHERE n = 20 AND bucket < 13')
def trading_buckets_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.trading_buckets(_days(spark, sf_dir), complete=True, most=13), "start", "end")


@query(_DAYS + " SELECT CAST(day AS VARCHAR) AS day FROM days WHERE day BETWEEN DATE '1998-06-01' - INTERVAL 730 DAY AND DATE '1998-06-01' ORDER BY days.day DESC LIMIT 120")
def last_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(M.last_days(_days(spark, sf_dir), 120, "1998-06-01"), "day")


@query(_COUNTS + """ SELECT l_suppkey, CAST(max(CASE WHEN bucket = 0 THEN groups END) AS BIGINT) AS current,
 (max(CASE WHEN bucket = 0 THEN groups END) - avg(CASE WHEN bucket > 0 THEN groups END)) / greatest(stddev_pop(CASE WHEN bucket > 0 THEN groups END), 1.0) AS z20 FROM grid GROUP BY l_suppkey""")
def z20_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).select("l_suppkey", "current", M.z20(F.col("current"), F.col("history")).alias("z20"))


@query(_COUNTS + """, s AS (SELECT l_suppkey, max(CASE WHEN bucket = 0 THEN groups END) AS c, avg(CASE WHEN bucket > 0 THEN groups END) AS m, var_samp(CASE WHEN bucket > 0 THEN groups END) AS v FROM grid GROUP BY 1)
 SELECT l_suppkey, (c - m) / sqrt(greatest(m, v, 1.0) * (1.0 + 1.0 / 12)) AS score, m AS mean, v AS variance, greatest(m, v, 1.0) * (1.0 + 1.0 / 12) AS predictive, c - m AS change, 'full' AS level FROM s""")
def warming_predictive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history(spark, sf_dir).withColumn("w", M.warming(F.col("current"), F.col("history")))
    level = M.coverage_level(F.col("history"), F.lit(True), F.lit(True))
    return rows.select("l_suppkey", "w.score", "w.mean", "w.variance", "w.predictive", "w.change", level.alias("level"))


@query(_COUNTS + """, now AS (SELECT DISTINCT l_suppkey, l_partkey FROM act WHERE bucket = 0), old AS (SELECT DISTINCT l_suppkey, l_partkey FROM act WHERE bucket BETWEEN 1 AND 5)
 SELECT l_suppkey, count(*) AS new_groups FROM (SELECT * FROM now EXCEPT SELECT * FROM old) GROUP BY 1""")
def new_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = M.trading_buckets(_days(spark, sf_dir), 20, complete=True, most=13)
    joined = _activity(spark, sf_dir).join(F.broadcast(buckets), F.col("on").between(F.col("start"), F.col("end")))
    return M.new_groups(joined, "l_suppkey", "l_partkey")


_WINDOW = _DAYS + """, w AS (SELECT day FROM days ORDER BY day DESC LIMIT 120), tw AS (SELECT count(DISTINCT (isoyear(day), week(day))) AS n FROM w),
g AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS unique_groups, max(CAST(l_shipdate AS DATE)) AS recent FROM lineitem GROUP BY 1),
i AS (SELECT DISTINCT l_suppkey, l_partkey, day FROM lineitem JOIN w ON CAST(l_shipdate AS DATE) = day),
a AS (SELECT l_suppkey, count(DISTINCT (isoyear(day), week(day))) AS active_weeks FROM i GROUP BY 1),
r AS (SELECT l_suppkey, count(*) FILTER (n >= 2) AS repeated FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
dd AS (SELECT l_suppkey, max(n) AS busiest, sum(n) AS pairs FROM (SELECT l_suppkey, day, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT l_suppkey, coalesce(active_weeks, 0) AS active_weeks, coalesce(active_weeks / tw.n, 0.0) AS active_week_ratio, unique_groups, coalesce(repeated / unique_groups, 0.0) AS repeat_ratio, coalesce(busiest / CAST(pairs AS DOUBLE), 0.0) AS concentration, recent
 FROM g LEFT JOIN a USING (l_suppkey) LEFT JOIN r USING (l_suppkey) LEFT JOIN dd USING (l_suppkey) CROSS JOIN tw)"""


def _persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.persistence(_activity(spark, sf_dir), M.last_days(_days(spark, sf_dir), 120), "l_suppkey", "l_partkey", "on")


@query(_WINDOW + " SELECT * REPLACE (CAST(recent AS VARCHAR) AS recent) FROM p")
def persistence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_persistence(spark, sf_dir), "recent")


@query(_WINDOW + """, q AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS lo, count(*) FILTER (l_returnflag = 'N') AS me, count(*) FILTER (l_returnflag = 'R') AS hi, count(*) AS n, bool_and(l_quantity > 1) AS dc FROM lineitem GROUP BY 1)
 SELECT l_suppkey, CASE WHEN unique_groups > 0 AND dc AND l_suppkey % 7 <> 0 THEN 100.0 * (0.40 * active_week_ratio + 0.25 * repeat_ratio + 0.20 * ((0.25 * lo + 0.6 * me + 1.0 * hi) / n) + 0.15 * (1.0 - concentration)) END AS rule_index FROM p JOIN q USING (l_suppkey)""")
def persistence_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    depth = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(M.depth_score(flag("A"), flag("N"), flag("R"), F.count("*")).alias("depth"), F.bool_and(F.col("l_quantity") > 1).alias("complete"))
    rows = _persistence(spark, sf_dir).join(depth, "l_suppkey")
    score = M.persistence_score(F.col("active_week_ratio"), F.col("repeat_ratio"), F.col("depth"), F.col("concentration"))
    status = F.when(F.col("l_suppkey") % 7 == 0, "missing_body").otherwise("available")
    return rows.select("l_suppkey", M.rule_index(score, F.col("unique_groups"), F.col("complete"), status, F.col("depth")).alias("rule_index"))


_PERIODS = "CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' THEN 'recent' WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '1997-10-01' AND DATE '1997-12-31' THEN 'prior' END"


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    period = F.when(day.between("1998-01-01", "1998-03-31"), "recent").when(day.between("1997-10-01", "1997-12-31"), "prior")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", period.alias("period")).where("period is not null")


@query(f"""WITH x AS (SELECT l_suppkey, l_partkey, {_PERIODS} AS p FROM lineitem), g AS (SELECT DISTINCT * FROM x WHERE p IS NOT NULL), k AS (SELECT DISTINCT l_suppkey FROM g),
n AS (SELECT l_suppkey, l_partkey FROM g WHERE p = 'recent' EXCEPT SELECT l_suppkey, l_partkey FROM g WHERE p = 'prior'), l AS (SELECT l_suppkey, l_partkey FROM g WHERE p = 'prior' EXCEPT SELECT l_suppkey, l_partkey FROM g WHERE p = 'recent')
SELECT k.l_suppkey, coalesce((SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) FROM n WHERE n.l_suppkey = k.l_suppkey), '') AS new_groups, coalesce((SELECT string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) FROM l WHERE l.l_suppkey = k.l_suppkey), '') AS lost_groups FROM k""")
def structural_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.structural_change(_periods(spark, sf_dir), "l_suppkey", "l_partkey", "l_returnflag", "period")
    return out.select("l_suppkey", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("new_groups", "lost_groups")))


@query(f"""WITH x AS (SELECT l_suppkey, l_returnflag, {_PERIODS} AS p FROM lineitem), c AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (p = 'prior') AS a, count(*) FILTER (p = 'recent') AS b FROM x WHERE p IS NOT NULL GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, CASE WHEN sum(b) OVER w > 0 THEN b / CAST(sum(b) OVER w AS DOUBLE) ELSE 0.0 END - CASE WHEN sum(a) OVER w > 0 THEN a / CAST(sum(a) OVER w AS DOUBLE) ELSE 0.0 END AS change FROM c WINDOW w AS (PARTITION BY l_suppkey)""")
def type_share_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.share_changes(_periods(spark, sf_dir), "l_suppkey", "l_returnflag", "period")


@query("""SELECT user_id, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS name, count(*) AS total FROM events GROUP BY 1, 2""")
def topic_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 5
    rows = table(spark, sf_dir, "events").select("user_id", F.create_map(F.concat(F.lit("k"), k.cast("string")), F.lit(1)).alias("counts"))
    return M.merge_counts(rows, "user_id", "counts")


@query("""SELECT l_suppkey, isoyear(l_shipdate) AS year, week(l_shipdate) AS week, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def iso_week_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", iso_week(F.col("l_shipdate").cast("date")).alias("w"))
    return rows.groupBy("l_suppkey", F.col("w.year").cast("long").alias("year"), F.col("w.week").cast("long").alias("week")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, 100.0 * least(1.0, greatest(0.0, (epoch_us(ts) / 1000000.0 - epoch_us(TIMESTAMP '2024-01-10') / 1000000.0) / (86400.0 * 10))) AS timeliness FROM events""")
def timeliness_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", timeliness(F.col("ts"), at("2024-01-10"), at("2024-01-20")).alias("timeliness"))


@query("""SELECT l_suppkey, CASE WHEN count(*) FILTER (NOT l_quantity > 25) = 0 THEN 'available' WHEN count(*) FILTER (l_quantity > 25) > 0 THEN 'partial_missing' ELSE 'missing_body' END AS status, bool_and(l_tax >= 0) AS dates_complete FROM lineitem GROUP BY 1""")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_quantity") > 25, "available").otherwise("missing_body").alias("status"), (F.col("l_tax") >= 0).alias("complete"))
    return M.evidence_status(rows, "l_suppkey", "status", "complete")
