"""Ranked boards on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import boards as B
from . import query, table


@query("""
WITH top AS (SELECT c_custkey, c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100),
last AS (SELECT max(o_orderdate) AS e FROM orders),
recent AS (SELECT o_orderkey, o_custkey FROM orders, last WHERE o_orderdate BETWEEN e - INTERVAL 30 DAY AND e),
a AS (SELECT n_name AS industry, count(DISTINCT c_custkey) AS a FROM top JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
b AS (SELECT n_name AS industry, count(DISTINCT o_orderkey) AS b FROM recent JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
j AS (SELECT a.industry, a, coalesce(b, 0) AS b FROM a LEFT JOIN b USING (industry)),
p AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 100.0 ELSE (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 - 1) / (count(*) OVER () - 1) * 100.0 END AS a_percentile,
  CASE WHEN count(*) OVER () = 1 THEN 100.0 ELSE (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 - 1) / (count(*) OVER () - 1) * 100.0 END AS b_percentile FROM j),
h AS (SELECT *, 0.5 * a_percentile + 0.5 * b_percentile AS heat FROM p)
SELECT *, CAST(row_number() OVER (ORDER BY heat DESC, a DESC, b DESC, industry) AS INTEGER) AS rank FROM h
""")
def industry_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    top = customer.orderBy(F.desc("c_acctbal"), F.asc("c_custkey")).limit(100)
    last = orders.agg(F.max("o_orderdate").alias("e"))
    recent = orders.join(F.broadcast(last), F.col("o_orderdate").between(F.col("e") - F.expr("interval 30 days"), F.col("e")))
    names = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("industry"))
    popular = top.join(names, "c_nationkey").select("industry", "c_custkey")
    articles = recent.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(customer.select("c_custkey", "c_nationkey"), "c_custkey").join(names, "c_nationkey").select("industry", "o_orderkey")
    return B.industry_heat(popular, articles, "industry", "c_custkey", "o_orderkey")


@query("""
SELECT user_id, count(DISTINCT event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS event_count, count(event_id) AS raw_count, max(ts) AS latest,
  CAST(row_number() OVER (ORDER BY count(DISTINCT event_type || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) DESC, max(ts) DESC, user_id) AS INTEGER) AS rank
FROM events GROUP BY user_id
""")
def heat_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("story", F.concat_ws("|", "event_type", F.col("ts").cast("date").cast("string")))
    return B.mention_heat(events, "user_id", "story", "event_id", "ts")


@query("""
WITH e AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS story, event_type FROM events),
k AS (SELECT DISTINCT user_id, story FROM e), t AS (SELECT DISTINCT story, event_type FROM e)
SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tags FROM k JOIN t USING (story) GROUP BY user_id
""")
def event_level_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("story", F.col("ts").cast("date").cast("string"))
    return B.event_tags(events, "user_id", "story", "event_type").select("user_id", F.array_join("tags", ",").alias("tags"))


@query("""
WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
a AS (SELECT q.conv_id, q.turn, min(r.turn) AS reply FROM q JOIN r ON q.conv_id = r.conv_id AND r.turn > q.turn GROUP BY 1, 2)
SELECT conv_id, count(*) AS question_count, max(reply) AS latest_reply, CAST(row_number() OVER (ORDER BY count(*) DESC, max(reply) DESC, conv_id) AS INTEGER) AS rank FROM a GROUP BY conv_id
""")
def qa_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    questions = turns.where("role = 'user'").select("conv_id", "turn")
    replies = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("reply"))
    answered = questions.join(replies, "conv_id").where("reply > turn").groupBy("conv_id", "turn").agg(F.min("reply").alias("reply"))
    per = answered.groupBy("conv_id").agg(F.count("*").alias("question_count"), F.max("reply").alias("latest_reply"))
    return B.ranked(per, [F.desc("question_count"), F.desc("latest_reply"), F.asc("conv_id")])


@query("""
SELECT c_custkey, c_mktsegment, CASE WHEN count(*) OVER s = 1 THEN 100.0 ELSE (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 - 1) / (count(*) OVER s - 1) * 100.0 END AS percentile
FROM customer WINDOW s AS (PARTITION BY c_mktsegment)
""")
def avg_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return B.average_rank_percentiles(customers, "c_nationkey", ["c_mktsegment"]).drop("c_nationkey")


@query("""
WITH n AS (SELECT s_suppkey, s_nationkey, count(l_orderkey) AS v FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT s_suppkey, s_nationkey, v, CASE WHEN count(*) OVER w >= 5 THEN (rank() OVER (PARTITION BY s_nationkey ORDER BY v) - 1 + 0.5 * count(*) OVER (PARTITION BY s_nationkey, v)) / count(*) OVER w * 100.0 END AS percentile
FROM n WINDOW w AS (PARTITION BY s_nationkey)
""")
def midrank_percentile_min_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, items = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    counts = items.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_orderkey").alias("v"))
    rows = supplier.join(counts, "s_suppkey", "left").select("s_suppkey", "s_nationkey", F.coalesce("v", F.lit(0)).alias("v"))
    return B.midrank_percentiles(rows, "v", ["s_nationkey"], 5)


@query("""
SELECT count(*) AS total, count(*) FILTER (path = 'explicit') AS explicit, count(*) FILTER (path = 'concept') AS concept, count(*) FILTER (path = 'stock') AS stock, count(*) FILTER (path = 'unknown_label') AS unknown_label,
  count(*) FILTER (path = 'unknown_concept') AS unknown_concept, count(*) FILTER (path = 'no_evidence') AS no_evidence, count(*) FILTER (path = 'stock_unmapped') AS stock_unmapped
FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'explicit' WHEN event_type = 'error' THEN 'unknown_label' WHEN user_id % 3 = 0 THEN 'concept' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'stock' WHEN c_mktsegment IS NOT NULL THEN 'stock_unmapped' WHEN user_id % 3 = 1 THEN 'unknown_concept' ELSE 'no_evidence' END AS path
  FROM events LEFT JOIN customer ON user_id = c_custkey)
""")
def attribution_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = F.create_map(*map(F.lit, ("click", "web", "view", "web", "three", "maths", "BUILDING", "homes", "MACHINERY", "tools")))
    joined = table(spark, sf_dir, "events").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id", "left")
    one = lambda c: F.array(c)
    tags = F.when(F.col("event_type").isin("click", "view", "error"), one(F.col("event_type")))
    concepts = F.when(F.col("user_id") % 3 == 0, one(F.lit("three"))).when(F.col("user_id") % 3 == 1, one(F.lit("other")))
    stocks = F.when(F.col("c_mktsegment").isNotNull(), one(F.col("c_mktsegment")))
    return B.path_counts(joined.select(B.attribution(tags, concepts, stocks, aliases)["path"].alias("path")))


@query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_brand IN ('Brand#4', 'Brand#7', 'Brand#23', '未标注')
""")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("tags", F.when(F.col("p_brand").isNotNull(), F.array("p_brand")))
    return B.facet_filter(part, "RING", ["p_name", "p_type"], {"tags": ["Brand#4", "Brand#7", "Brand#23", "未标注"]}).select("p_partkey", "p_name", "p_brand")


@query("""
WITH u AS (SELECT c_custkey AS code, c_name AS name, 0 AS p FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT p_partkey, p_name, 2 FROM part WHERE p_partkey % 5 = 0)
SELECT c.c_custkey AS code, coalesce(arg_max(u.name, u.p), CAST(c.c_custkey AS VARCHAR)) AS name FROM customer c LEFT JOIN u ON c.c_custkey = u.code GROUP BY c.c_custkey
""")
def name_lookup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, part = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    code = lambda df, c, *names: df.select(F.col(c).alias("code"), *names)
    sources = [(code(customer.where("c_custkey % 2 = 0"), "c_custkey", "c_name"), "c_name"), (code(supplier, "s_suppkey", "s_name"), "s_name"), (code(part.where("p_partkey % 5 = 0"), "p_partkey", "p_name"), "p_name")]
    return B.name_lookup(code(customer, "c_custkey"), "code", sources)


@query("""
WITH u AS (SELECT user_id AS k, event_type AS v, 0 AS p, event_id AS i FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, event_type, 1, event_id FROM events WHERE event_type <> 'purchase')
SELECT k, v, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, i) AS n FROM u) WHERE n = 1
""")
def ordered_union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), F.col("event_id").alias("i"))
    first = lambda df: df.groupBy("k").agg(F.min_by("v", "i").alias("v"), F.min("i").alias("i"))
    return B.ordered_union([first(events.where("v = 'purchase'")), first(events.where("v <> 'purchase'"))], ["k"]).select("k", "v", "i")


@query("""
SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.first_per_key(table(spark, sf_dir, "events"), ["event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id", "ts")


@query("""
SELECT s_suppkey, s_acctbal, CAST(row_number() OVER (ORDER BY s_acctbal IS NULL OR s_acctbal < 0, CASE WHEN s_acctbal >= 0 THEN s_acctbal END DESC, s_nationkey DESC, s_suppkey) AS INTEGER) AS rank FROM supplier
""")
def board_order_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").withColumn("z", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    return B.ranked(rows, [F.col("z").desc_nulls_last(), F.desc("s_nationkey"), F.asc("s_suppkey")]).select("s_suppkey", "s_acctbal", "rank")


@query("""
SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def top_k_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ranked(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], top=20).select("o_orderkey", "o_totalprice", "rank")


@query("""
SELECT doc_id, substr(sha1(string_agg(CAST(item AS VARCHAR), chr(10) ORDER BY CAST(item AS VARCHAR))), 1, 16) AS event_id FROM (SELECT o_custkey AS doc_id, o_orderkey AS item FROM orders) GROUP BY doc_id
""")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    members = F.array_join(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))), "\n")
    return orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(X.short_id(members).alias("event_id"))
