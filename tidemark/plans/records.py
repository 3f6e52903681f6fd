"""Feeds, dates, metric boards, extraction and clustering on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import boards as B
from ..operators import clustering, evaluation, extraction, state
from ..operators import metrics as M
from ..operators.extraction_rules import Rule
from ..sources import feeds, sinks
from . import metrics, query, table
from .session import cut


@query(metrics._COUNTS + """, z AS (SELECT l_suppkey, max(CASE WHEN bucket = 0 THEN groups END) AS current, (max(CASE WHEN bucket = 0 THEN groups END) - avg(CASE WHEN bucket > 0 THEN groups END)) / greatest(stddev_pop(CASE WHEN bucket > 0 THEN groups END), 1.0) AS z FROM grid GROUP BY 1),
 r AS (SELECT l_suppkey, max(CAST(l_shipdate AS DATE)) AS recent FROM lineitem GROUP BY 1)
 SELECT l_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE round(z, 6) END DESC NULLS LAST, current DESC, recent DESC, l_suppkey) AS INTEGER) AS rank FROM z JOIN r USING (l_suppkey)""")
def z20_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max(F.col("l_shipdate").cast("date")).alias("recent"))
    rows = metrics._history(spark, sf_dir).join(recent, "l_suppkey").withColumn("z", F.when(F.col("l_suppkey") % 6 != 0, F.round(M.z20(F.col("current"), F.col("history")), 6)))
    return B.ranked(rows, [F.col("z").desc_nulls_last(), F.desc("current"), F.desc("recent"), F.asc("l_suppkey")]).select("l_suppkey", "rank")


@query(metrics._COUNTS + """, s AS (SELECT l_suppkey, max(CASE WHEN bucket = 0 THEN groups END) AS c, avg(CASE WHEN bucket > 0 THEN groups END) AS m, var_samp(CASE WHEN bucket > 0 THEN groups END) AS v FROM grid GROUP BY 1)
 SELECT l_suppkey, CAST(row_number() OVER (ORDER BY l_suppkey % 3, round((c - m) / sqrt(greatest(m, v, 1.0) * (1.0 + 1.0 / 12)), 6) DESC, c DESC, l_suppkey) AS INTEGER) AS rank FROM s""")
def warming_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(M.warming(F.col("current"), F.col("history"))["score"], 6)
    rows = metrics._history(spark, sf_dir).withColumns({"score": score, "level": F.col("l_suppkey") % 3})
    return B.ranked(rows, [F.asc("level"), F.col("score").desc_nulls_last(), F.desc("current"), F.asc("l_suppkey")]).select("l_suppkey", "rank")


@query(metrics._WINDOW + """ SELECT l_suppkey, CAST(row_number() OVER (ORDER BY active_weeks DESC, unique_groups DESC, recent DESC, l_suppkey) AS INTEGER) AS rank FROM p""")
def persistence_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ranked(metrics._persistence(spark, sf_dir), [F.desc("active_weeks"), F.desc("unique_groups"), F.desc("recent"), F.asc("l_suppkey")]).select("l_suppkey", "rank")


@query(metrics._DAYS + """ SELECT o_orderkey, (SELECT count(*) FROM days WHERE day BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 30) AS n FROM orders""")
def trading_day_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = metrics._days(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 30))).alias("day"))
    return orders.join(F.broadcast(days.withColumn("open", F.lit(1))), "day", "left").groupBy("o_orderkey").agg(F.count("open").alias("n"))


@query("""SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN NULL WHEN make_timestamp(2026, month(o_orderdate), day(o_orderdate), 8, 30, 0) <= TIMESTAMP '2026-03-11 12:00:00' THEN make_timestamp(2026, month(o_orderdate), day(o_orderdate), 8, 30, 0) ELSE make_timestamp(2025, month(o_orderdate), day(o_orderdate), 8, 30, 0) END AS VARCHAR) AS at FROM orders""")
def list_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leap day fits neither of two common years and has no time."""
    day = F.col("o_orderdate")
    at = D.latest_year(F.month(day), F.day(day), F.lit(8), F.lit(30), F.lit("2026-03-10 12:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_id, CAST(date_trunc('second', TIMESTAMP '2024-02-01' - to_seconds((event_id % 50) * CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 ELSE 604800 END)) AS VARCHAR) AS at FROM events""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    unit = F.element_at(F.array(*map(F.lit, ("分钟", "小时", "天", "周"))), (i % 4).cast("int") + 1)
    at = D.relative_time(F.concat((i % 50).cast("string"), unit, F.lit("前")), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT event_id, CAST(date_trunc('second', ts + INTERVAL 8 HOUR) AS VARCHAR) AS at FROM events""")
def epoch_feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return table(spark, sf_dir, "events").select("event_id", F.date_format(D.from_epoch_ms(ms), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]', 1)) AS url FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.list_items(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "url")


@query("""SELECT c.c_custkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0) n USING (c_custkey)""")
def quote_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = old.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, 0.0).alias("c_acctbal"), F.when(F.col("c_custkey") % 5 == 0, "NEW").alias("c_mktsegment"))
    return feeds.repaired(old, new, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("""SELECT p_partkey, split_part(replace(p_type, ' ', '-'), '-', 1) AS industry FROM part""")
def industry_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", feeds.industry_label(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("industry"))


@query("""SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || chr(9) || s_name || chr(9) || CAST(s_nationkey AS VARCHAR) AS line FROM supplier""")
def tsv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", sinks.tsv(["s_suppkey", "s_name", "s_nationkey"]).alias("line"))


@query("""SELECT event_id, k IS NOT NULL AND k BETWEEN 0 AND 80 AND event_type IN ('click', 'view', 'purchase') AS valid, CASE WHEN k <= 80 THEN 'model' ELSE 'rules_fallback' END AS extractor FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    valid = k.isNotNull() & k.between(0, 80) & F.col("event_type").isin("click", "view", "purchase")
    return table(spark, sf_dir, "events").select("event_id", valid.alias("valid"), F.coalesce(F.when(k <= 80, "model"), F.lit("rules_fallback")).alias("extractor"))


@query("""SELECT n_regionkey, min(n_name) AS name, count(*) AS n FROM nation WHERE n_name <> '' GROUP BY 1""")
def min_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_name <> ''").groupBy("n_regionkey").agg(F.min("n_name").alias("name"), F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-31' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def range_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(at("1998-01-01"), at("1998-03-31"))).join(ids, "o_custkey", "left_semi").select("o_custkey", "o_orderkey", "o_orderdate")


_RULES = (
    Rule("licensing", r"[Ll]icen[cs]e", "terms are stated", levels=((r"GNU", 3), (r"MIT", 2)), stages=((r"Released", "executed"), (r"Licensed", "signed"))),
    Rule("disclosure", r"token = ", "a credential is shown", not_title=r"\|", level=1),
)


@query()
def event_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extraction operator with two rules for this corpus: the line with the hit is the headline."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike("[Ll]icen[cs]e|token = "))).alias("title"))
    rows = docs.select(F.col("doc_id").cast("string").alias("event_id"), F.col("source").alias("stock_code"), F.col("doc_id").cast("string").alias("document_id"), F.lit("cninfo").alias("provider_key"), "title", F.col("text").alias("body"))
    found = extraction.leading_facts(extraction.detect(rows, _RULES))
    return found.select("event_id", "event_type", "stage", "level", "evidence_id", "leads")


@query()
def persistent_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    docs = orders.select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"), F.concat(F.round("o_totalprice", -4).cast("long").cast("string"), F.lit("元")).alias("body"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("kind_hint"), F.array(F.col("o_custkey").cast("string")).alias("codes"),
    )
    return clustering.cluster_documents(docs)


@query("""WITH o AS (SELECT o_custkey, o_orderpriority AS p, o_orderkey, epoch(o_orderdate)::BIGINT AS t, CAST(o_orderkey AS VARCHAR) AS id FROM orders),
 g AS (SELECT *, coalesce(t - lag(t) OVER w > 259200, true) AS opens, t - lag(t) OVER w AS gap FROM o WINDOW w AS (PARTITION BY o_custkey, p ORDER BY t, id)),
 r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY o_custkey, p ORDER BY t, id) AS run FROM g),
 f AS (SELECT o_custkey, p, run, substr(sha1(arg_min(id, (t, id))), 1, 16) AS event_id, min(gap) FILTER (opens) AS gap FROM r GROUP BY 1, 2, 3),
 h AS (SELECT *, CASE WHEN gap <= 15552000 THEN lag(event_id) OVER (PARTITION BY o_custkey, p ORDER BY run) END AS historical_event_id FROM f)
 SELECT id AS document_id, event_id, historical_event_id FROM r JOIN h USING (o_custkey, p, run)""")
def cluster_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistent clusters of orders whose titles are alike only if equal: chains within 72 hours, linked to older ones."""
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.md5("o_orderpriority").alias("title"), F.lit("").alias("body"),
        none.alias("url"), none.alias("content_hash"), none.alias("kind_hint"), F.array(F.col("o_custkey").cast("string")).alias("codes"),
    )
    return clustering.cluster_documents(docs)


#: Documents of one customer: hours, title, body, the document whose event each is in, and the event it resembles.
_CASE = (
    (0, "关于新药获批的公告", "金额5亿元", 0, None), (3, "关于新药获批的公告", "金额6亿元", 0, None),  # approvals of a day, whatever their amounts
    (30, "关于新药获批的公告", "金额7亿元", 2, None),  # another day and another amount
    (200, "2025年半年度报告", "净利润1亿元", 3, None), (202, "2025年半年度报告摘要", "净利润2亿元", 3, None),  # a report and its summary
    (400, "关于回购股份方案的公告", "金额3亿元", 5, None), (405, "回购进展核查意见", "金额4亿元", 5, None),  # buybacks of a day
    (600, "与甲方签订重大合同的公告", "合同金额8亿元", 7, None), (670, "与甲方签订重大合同公告", "合同金额8亿元", 7, None),  # alike titles and equal amounts
    (671, "与甲方签订重大合同的公告", "合同金额9亿元", 9, None),  # a conflict of amounts
    (900, "与甲方签订重大合同的公告", "合同金额8亿元", 10, 7),  # beyond 72 hours: a new event that resembles the old one
    (6000, "与甲方签订重大合同的公告", "合同金额8亿元", 11, None),  # beyond 180 days
)


@query(f"""SELECT c_custkey || '-' || lpad(CAST(i AS VARCHAR), 2, '0') AS document_id, substr(sha1(c_custkey || '-' || lpad(CAST(home AS VARCHAR), 2, '0')), 1, 16) AS event_id, substr(sha1(c_custkey || '-' || lpad(CAST(past AS VARCHAR), 2, '0')), 1, 16) AS historical_event_id
 FROM customer, (VALUES {', '.join(f"({i}, {home}, {'NULL' if past is None else past})" for i, (*_, home, past) in enumerate(_CASE))}) v(i, home, past)""")
def cluster_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge test in order, in batches: each customer's documents come in three, and only its own block is folded again."""
    cases = F.posexplode(F.array(*(F.struct(F.lit(h).alias("hours"), F.lit(t).alias("title"), F.lit(b).alias("body")) for h, t, b, *_ in _CASE)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", cases.alias("i", "d"))
    at = F.to_timestamp(F.lit("2026-01-05 01:00:00")) + F.make_dt_interval(hours=F.col("d.hours"))
    none = F.lit(None).cast("string")
    docs = rows.select(
        F.concat_ws("-", F.col("c_custkey").cast("string"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("document_id"), at.alias("at"), "d.title", "d.body", none.alias("url"), none.alias("content_hash"), none.alias("kind_hint"), F.array(F.col("c_custkey").cast("string")).alias("codes"), "i"
    )
    stored = None
    for part in (F.col("i") % 3 == 1, F.col("i") % 3 == 0, F.lit(True)):
        stored = cut(clustering.add_documents(stored, docs.where(part).drop("i")))
    return stored.select("document_id", "event_id", "historical_event_id")


@query("""SELECT count(*) AS n, count(*) FILTER (r.s = l.s) AS unchanged, count(*) FILTER (r.s <> l.s) AS corrected FROM (SELECT l_suppkey, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1) l JOIN (SELECT l_suppkey, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-02-01' GROUP BY 1) r USING (l_suppkey)""")
def correction_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = lambda day: table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit(day).cast("timestamp_ntz")).groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias(day))
    a, b = "1996-01-01", "1996-02-01"
    both = before(a).join(before(b), "l_suppkey")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col(f"`{a}`") == F.col(f"`{b}`")).alias("unchanged"), F.count_if(F.col(f"`{a}`") != F.col(f"`{b}`")).alias("corrected"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 1) / CAST(nullif(count(quality), 0) AS DOUBLE) AS entity_precision, count(*) FILTER (quality = 1 AND toxic = 0) / CAST(nullif(count(*) FILTER (quality = 1), 0) AS DOUBLE) AS group_precision FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def entity_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.count_if(F.col("quality") == 1)
    return rows.groupBy("source").agg(F.count("*").alias("n"), evaluation.ratio(good, F.count("quality")).alias("entity_precision"), evaluation.ratio(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), good).alias("group_precision"))


@query("""SELECT event_type, max(event_id) FILTER (ok) AS last_success, CASE WHEN max(event_id) FILTER (ok) >= 9000 THEN 'reuse' ELSE 'stale' END AS cache FROM (SELECT *, value > 10 AS ok FROM events) GROUP BY 1""")
def source_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.when(F.col("value") > 10, F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(last.alias("last_success"), F.when(last >= 9000, "reuse").otherwise("stale").alias("cache"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY""")
def retention_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return state.retained(orders.crossJoin(F.broadcast(orders.agg(F.max("o_orderdate").alias("now")))), "o_orderdate", F.col("now"), 400).select("o_orderkey")
