"""Announcements and activity records written from the shared tables' keys, so that SQL knows what each one says."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as X
from ..operators import answers, extraction, folds, joins, participants, research, scoring
from ..sources import articles, feeds, listings, sinks
from . import query, table
from .session import shared_dir, spread

#: Title and body of an announcement for each remainder of the key; {n} is an amount, {p} a percentage.
TEXTS = (
    ("2025年度业绩预告", "公司业绩预告：预计净利润{n}亿元，净利润同比增长{p}%，业绩预增。"),
    ("关于签订重大合同的公告", "公司签订重大合同，合同金额{n}亿元，占公司营业收入的{p}%，合同已签署。"),
    ("产品涨价公告", "公司产品涨价，上调幅度为{p}%，利好业绩。"),
    ("关于药品获批的公告", "公司产品获批，已取得药品注册证，将实现商业化。"),
    ("关于回购股份方案的公告", "公司以{n}亿元回购股份，占总股本的{p}%，回购方案已审议通过。"),
    ("关于收购股权的公告", "公司收购某公司股权，交易金额{n}亿元，增强协同，协议已签署。"),
    ("新项目投产公告", "公司新增产能项目已正式投产，金额{n}亿元，产能释放。"),
    ("政策利好公告", "以旧换新政策利好落地，公司直接受益。"),
    ("公司进入供应链公告", "公司产品进入某某汽车供应链，获得量产定点。"),
    ("关于收到政府补助的公告", "公司收到政府补助{n}亿元，占净利润的{p}%。"),
    ("2025年度现金分红方案实施公告", "公司现金分红{n}亿元，占净利润比例为{p}%，本次现金分红已实施完毕，股东回报提升。"),
    ("关于临床试验达到主要终点的公告", "公司产品临床试验达到主要终点，关键技术验证取得突破。"),
    ("关于撤销退市风险警示的公告", "公司申请撤销退市风险警示已获同意，涉及金额{n}亿元。"),
    ("股权激励计划草案", "股权激励计划的激励对象为100人，授予数量为{n}00万股，业绩考核指标为净利润增长。"),
    ("关于向特定对象发行完成的公告", "公司向特定对象发行股票完成，募集资金{n}亿元已到账。"),
    ("关于出售资产的公告", "公司出售资产已完成交割，回收现金{n}亿元，增加投资收益。"),
    ("关于终止现金分红方案的公告", "董事会决定终止现金分红方案。"),
    ("关于专利获批的公告", "公司专利获批，取得证书。"),
    ("2025年度送股转增方案公告", "利润分配预案为每10股送3股转增2股。"),
    ("关于召开股东大会的公告", "公司将召开股东大会。"),
)
#: What the announcements report: ratio and amount by whether their text states one.
_FACTS = """
WITH facts(k, event_type, direction, stage, level, ratio, yuan) AS (VALUES
 (0, 'earnings_upgrade', 'positive', 'framework', NULL, true, 100000000.0), (1, 'major_contract', 'positive', 'signed', NULL, true, 100000000.0), (2, 'price_increase', 'positive', 'framework', NULL, true, NULL),
 (3, 'approval', 'positive', 'executed', 2, false, NULL), (4, 'buyback_or_increase', 'positive', 'signed', NULL, true, 100000000.0), (5, 'mna', 'positive', 'signed', 3, false, 100000000.0),
 (6, 'capacity_launch', 'positive', 'executed', 2, false, 100000000.0), (7, 'direct_policy_benefit', 'positive', 'framework', 2, false, NULL), (8, 'customer_breakthrough', 'positive', 'framework', 2, false, NULL),
 (9, 'subsidy_or_compensation', 'positive', 'framework', NULL, true, 100000000.0), (10, 'shareholder_return', 'positive', 'executed', NULL, true, 100000000.0), (11, 'rd_milestone', 'positive', 'awarded', 2, false, NULL),
 (12, 'risk_resolution', 'positive', 'executed', 2, false, 100000000.0), (13, 'equity_incentive', 'positive', 'framework', 2, false, 1000000.0), (14, 'financing_completion', 'positive', 'executed', 1, false, 100000000.0),
 (15, 'asset_disposal', 'positive', 'executed', 2, false, 100000000.0), (16, 'shareholder_return', 'negative', 'signed', 0, false, NULL)),
o AS (SELECT o_orderkey, o_orderkey % 20 AS k, o_orderkey % 9 + 1 AS n, o_orderkey % 60 + 1 AS p FROM orders)
"""


def _pick(values: tuple[str, ...] | list[str], key: Column) -> Column:
    """The value of a key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values)).cast("int") + 1)


def _filled(texts: list[str], key: Column) -> Column:
    said = F.replace(_pick(texts, key), F.lit("{n}"), (key % 9 + 1).cast("string"))
    return F.replace(said, F.lit("{p}"), (key % 60 + 1).cast("string"))


def _announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key, F.col("o_custkey").cast("string").alias("stock_code"), _pick([t for t, _ in TEXTS], key).alias("title"), _filled([b for _, b in TEXTS], key).alias("body"))


@query(_FACTS + """SELECT o_orderkey, event_type, direction, stage, true AS leads,
 CAST(CASE WHEN level IS NOT NULL THEN level WHEN k = 4 THEN CASE WHEN p >= 3 THEN 4 ELSE 3 END WHEN p >= 30 THEN 4 WHEN p >= 15 THEN 3 WHEN p >= 5 THEN 2 ELSE 1 END AS INTEGER) AS level,
 CASE WHEN ratio THEN CAST(p AS DOUBLE) / 100 END AS ratio, CAST(n AS DOUBLE) * CAST(yuan AS DOUBLE) AS amount FROM o JOIN facts USING (k)""")
def event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen rules over announcements of each type, and of some that report none."""
    docs = _announcements(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("event_id"), "stock_code", F.col("o_orderkey").cast("string").alias("document_id"), F.lit("cninfo").alias("provider_key"), "title", "body")
    found = extraction.leading_facts(extraction.detect(docs))
    return found.select(F.col("event_id").cast("long").alias("o_orderkey"), "event_type", "direction", "stage", "leads", "level", "ratio", "amount")


#: Announcements that look like an event of a type and are none, or another, or one without a mechanism.
EXCLUDED = (
    ("关于送股转增方案的公告", "利润分配预案为每10股送3股转增2股。"), ("关于专利获批的公告", "公司专利获批，取得证书。"), ("关于取消税收优惠的公告", "税收优惠取消，公司成本将受影响。"), ("股权激励计划草案", "股权激励计划将实施。"),
    ("2026年半年度报告", "半年度报告显示净利润为-5000万元，业绩下降。"), ("公司中标订单并进入供应链的公告", "公司获得订单，进入某某汽车供应链，批量供货。"), ("关于调整回购价格的公告", "公司调整回购价格。"),
    ("关于补偿事项的公告", "公司不存在向投资者提供补偿的情形。"), ("限制性股票回购注销公告", "限制性股票回购注销完成。"), ("关于全资子公司吸收合并的公告", "全资子公司吸收合并已完成。"),
)


@query("""SELECT o_orderkey, event_type, direction, mechanism, stage, CAST(level AS INTEGER) AS level FROM orders JOIN (VALUES (3, 'equity_incentive', 'neutral', false, 'framework', 0), (4, 'earnings_upgrade', 'negative', false, 'executed', 0), (5, 'customer_breakthrough', 'positive', true, 'awarded', 2)) v(k, event_type, direction, mechanism, stage, level) ON o_orderkey % 10 = k""")
def event_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules leave out: titles and texts of other matters, terms that are missing, and losses."""
    key = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(key.cast("string").alias("event_id"), F.col("o_custkey").cast("string").alias("stock_code"), key.cast("string").alias("document_id"), F.lit("cninfo").alias("provider_key"), _pick([t for t, _ in EXCLUDED], key).alias("title"), _pick([b for _, b in EXCLUDED], key).alias("body"))
    found = extraction.detect(docs)
    return found.select(F.col("event_id").cast("long").alias("o_orderkey"), "event_type", "direction", F.col("mechanism").isNotNull().alias("mechanism"), "stage", "level")


_BEATS = "超预期"


@query(_FACTS.rstrip().removesuffix("FROM orders)") + f""", o_custkey % 10 AS stock, o_orderdate AS at, o_orderkey % 7 = 0 AS beats FROM orders),
 e AS (SELECT o.*, event_type, [{', '.join(repr(t + chr(10) + b) for t, b in TEXTS)}][k + 1] AS said FROM o JOIN facts USING (k)),
 h AS (SELECT a.o_orderkey, arg_max(b.o_orderkey, (b.at, b.o_orderkey)) AS past FROM e a JOIN o b ON a.stock = b.stock AND a.k = b.k AND b.at <= a.at - INTERVAL 72 HOUR AND b.at >= a.at - INTERVAL 180 DAY GROUP BY 1)
 SELECT e.o_orderkey, event_type, past, CASE WHEN past IS NULL THEN 100.0 WHEN regexp_matches(said, '[{{]n[}}](亿元|00万)') AND e.n <> past % 9 + 1 THEN 60.0 ELSE 30.0 END::DOUBLE AS novelty,
 CASE WHEN beats THEN 100.0 WHEN contains(said, '突破') THEN 75.0 WHEN past IS NULL THEN 50.0 WHEN contains(said, '公告') THEN 25.0 ELSE 0.0 END::DOUBLE AS unexpectedness FROM e LEFT JOIN h USING (o_orderkey)""")
def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported events scored against the newest one of their stock and kind, 72 hours to 180 days before."""
    more = F.when(F.col("o_orderkey") % 7 == 0, _BEATS).otherwise("")
    docs = _announcements(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at")), "o_orderkey")
    docs = docs.select(F.col("o_orderkey").cast("string").alias("event_id"), (F.col("o_custkey") % 10).cast("string").alias("stock_code"), F.col("o_orderkey").cast("string").alias("document_id"), F.lit("cninfo").alias("provider_key"), "title", F.concat("body", more).alias("body"), "at", (F.col("o_custkey") % 10 * 20 + F.col("o_orderkey") % 20).alias("kind"))
    past = docs.select("kind", F.col("event_id").cast("long").alias("past"), F.col("at").alias("past_at"))
    links = joins.newest_before(docs.select("kind", "event_id", "at"), past, "kind", "event_id", "at", "past", "past_at", "72 hours", "180 days")
    links = links.select("event_id", F.col("past").cast("string").alias("historical_event_id"))
    found = extraction.with_history(extraction.detect(docs), docs, links)
    return found.select(F.col("event_id").cast("long").alias("o_orderkey"), "event_type", F.col("historical_event_id").cast("long").alias("past"), "novelty", "unexpectedness")


@query(_FACTS + "SELECT o_orderkey, event_type AS hint FROM o LEFT JOIN facts USING (k)")
def event_type_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _announcements(spark, sf_dir).select("o_orderkey", F.concat_ws("\n", "title", "body").alias("text"))
    return extraction.event_type_hint(docs, "o_orderkey", "text")


FUNDS, FOREIGN, OTHERS = ("南方基金", "中金公司", "平安证券", "太平洋保险"), ("DM Capital Limited", "华能信托", "中信银行"), ("华泰证券", "高毅资产")
KINDS = (("调研方式：现场调研", "survey"), ("形式：路演", "roadshow"), ("形式：业绩说明会", "performance_briefing"))


def _sql_pick(values, key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({key} % {len(values)} AS INTEGER) + 1]"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    day = F.concat(F.lit("2025年"), (key % 12 + 1).cast("string"), F.lit("月"), (key % 20 + 1).cast("string"), F.lit("日"))
    names = F.concat(_pick(FUNDS, key), F.lit("、"), _pick(FOREIGN, key), F.lit("、"), _pick(OTHERS, key))
    text = F.concat(
        F.lit("投资者关系活动记录表\n活动时间："), day, F.lit("\n"), _pick([k for k, _ in KINDS], key), F.lit("\n参与单位名称：约"), (key % 40 + 2).cast("string"), F.lit("家机构，"), names,
        F.lit("：王龙钰\n地点：公司会议室\n问：公司产能利用率和订单情况如何？\n答：利用率较高。\n"), F.repeat(F.lit("Q2：未来战略规划？\n"), (key % 3).cast("int")),
    )
    return spread(table(spark, sf_dir, "customer").select(key), "c_custkey").select(key, text.alias("text"))


@query(f"""SELECT c_custkey, {_sql_pick([k for _, k in KINDS], 'c_custkey')} AS kind, CAST(c_custkey % 40 + 2 AS INTEGER) AS reported, CAST(1 + c_custkey % 3 AS INTEGER) AS questions,
 'medium:orders' || repeat(',low:growth', CAST(c_custkey % 3 AS INTEGER)) AS asked, {_sql_pick(FUNDS, 'c_custkey')} || ',' || {_sql_pick(FOREIGN, 'c_custkey')} || ',' || {_sql_pick(OTHERS, 'c_custkey')} AS participants FROM customer""")
def activity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    read = _records(spark, sf_dir).select("c_custkey", research.activity_kind(text).alias("kind"), research.reported_count(text).alias("reported"), research.questions(text).alias("q"), research.participants(text).alias("people"))
    return read.select("c_custkey", "kind", "reported", F.size("q").alias("questions"), F.array_join(F.transform("q", lambda q: F.concat_ws(":", q["depth"], q["topic"])), ",").alias("asked"), F.array_join("people", ",").alias("participants"))


@query(f"""SELECT c_custkey, pos, name, CASE pos WHEN 1 THEN name || {_sql_pick(("研究部", "", "（上海）"), 'c_custkey')} ELSE name END AS context, pos = 3 OR pos = 1 AND c_custkey % 3 = 0 AS eligible
 FROM customer, (VALUES (1, '平安银行'), (2, '招商银行'), (3, '华泰证券')) v(pos, name)""")
def mention_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each organisation judged by its own list item: a bank's research department counts for that bank alone."""
    key = F.col("c_custkey")
    line = F.concat(F.lit("平安银行"), _pick(("研究部", "", "（上海）"), key), F.lit(" ， 招商银行;华泰证券"))
    names = F.posexplode(F.array(F.lit("平安银行"), F.lit("招商银行"), F.lit("华泰证券")))
    rows = spread(table(spark, sf_dir, "customer").select(key), "c_custkey").select(key, line.alias("line"), names.alias("pos", "name")).withColumn("context", research.mention_context(F.col("line"), F.col("name")))
    counts = research.eligibility(F.col("name"), research.institution_type(F.col("name")), F.col("context"))["eligible"]
    return rows.select(key, (F.col("pos") + 1).alias("pos"), "name", "context", counts.alias("eligible"))


@query(f"""SELECT c_custkey, 'activity:' || substr(sha1(c_custkey || '|600000'), 1, 16) AS activity_id, CAST(make_date(2025, CAST(c_custkey % 12 + 1 AS INTEGER), CAST(c_custkey % 20 + 1 AS INTEGER)) AS VARCHAR) AS days, 'explicit' AS precision, {_sql_pick([k for _, k in KINDS], 'c_custkey')} AS kind,
 CAST(c_custkey % 40 + 2 AS INTEGER) AS reported, CAST(1 + c_custkey % 3 AS INTEGER) AS question_count, 'low=' || CAST(c_custkey % 3 AS VARCHAR) || ',medium=1,high=0' AS depths, 'orders=1' || CASE WHEN c_custkey % 3 > 0 THEN ',growth=' || CAST(c_custkey % 3 AS VARCHAR) ELSE '' END AS topics FROM customer""")
def assembled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole activity records, one row each; maps are shown as text."""
    rows = _records(spark, sf_dir).select("c_custkey", F.lit("600000").alias("code"), "text", F.lit("2025-12-31 10:00:00").cast("timestamp_ntz").alias("published"))
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    out = research.assembled(rows, "c_custkey", "code", "text", "published")
    return out.select("c_custkey", "activity_id", F.array_join(F.col("days").cast("array<string>"), ",").alias("days"), "precision", "kind", "reported", "question_count", shown("depth_counts").alias("depths"), shown("topic_counts").alias("topics"))


HAN_DIGITS = "零一二三四五六七八九"


def _fund(key: Column) -> Column:
    """A made name without a telling ending: the key in Chinese digits."""
    return F.concat(F.translate(key.cast("string"), "0123456789", HAN_DIGITS), F.lit("谷汇融"))


_SQL_FUND = f"translate(CAST({{}} AS VARCHAR), '0123456789', '{HAN_DIGITS}') || '谷汇融'"


@query(f"""WITH n AS (SELECT count(*) AS n FROM supplier), o AS (SELECT o_orderkey, {_SQL_FUND.format("o_custkey % n")} AS a, {_SQL_FUND.format("o_orderkey % n")} AS b, o_orderkey % 4 AS k FROM orders, n),
 v AS (SELECT *, unnest(CASE k WHEN 0 THEN ['国寿安保基金', '正心谷', a, '高毅资产', b, '华泰资产'] WHEN 1 THEN ['淡水泉投资', a, b, '和风亚洲基金'] WHEN 2 THEN ['南方基金', a, '西南证券'] ELSE [a, '敦美投资', 'TX Capital'] END) AS name,
  unnest(range(6)) AS pos FROM o)
 SELECT o_orderkey, string_agg(name, ',' ORDER BY pos) AS names FROM (SELECT o_orderkey, name, min(pos) AS pos FROM v WHERE name IS NOT NULL GROUP BY ALL) GROUP BY o_orderkey""")
def listed_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with names broken over lines, glued, joined by 和, with persons or remarks; made names are the suppliers'."""
    known = table(spark, sf_dir, "supplier").select(research.normalize_institution(_fund(F.col("s_suppkey"))).alias("alias"))
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))  # one row
    orders = table(spark, sf_dir, "orders").crossJoin(F.broadcast(n)).select("o_orderkey", _fund(F.col("o_custkey") % F.col("n")).alias("a"), _fund(F.col("o_orderkey") % F.col("n")).alias("b"))
    a, b, say = F.col("a"), F.col("b"), F.lit
    kinds = [
        F.concat(say("参与单位名称\n国寿安保基金、正心谷"), a, say("、高\n毅资产、"), F.substring(b, F.lit(1), F.length(b) - 1), say("\n"), F.substring(b, F.length(b), F.lit(1)), say("、华泰资产及个\n人投资者等\n时间 2026年5月11日\n")),
        F.concat(say("参与单位：淡水泉投资和"), a, say("、和"), b, say("、和风亚洲基金\n交流内容：略\n")),
        F.concat(say("参与单位名称及人员姓名\n南方基金史博、应帅、邹寅隆、"), a, say("周泰、西南证券王龙钰\n时间 2026年5月15日\n")),
        F.concat(say("参与单位名称\n"), a, say("：李晓光\n2、敦美投资：王千\nTX Capital: A B\n地点：会议室\n")),
    ]
    text = orders.select("o_orderkey", F.element_at(F.array(*kinds), (F.col("o_orderkey") % 4).cast("int") + 1).alias("text"))
    return participants.listed_names(text, "o_orderkey", "text", known, "alias").select("o_orderkey", F.array_join("names", ",").alias("names"))


_DAY = "make_date(2025, CAST(c_custkey % 12 + 1 AS INTEGER), CAST(c_custkey % 20 + 1 AS INTEGER))"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled day, a labelled range of three days, and no date, in turn."""
    key = F.col("c_custkey")
    first = F.concat(F.lit("活动时间：2025年"), (key % 12 + 1).cast("string"), F.lit("月"), (key % 20 + 1).cast("string"), F.lit("日"))
    text = F.when(key % 3 == 0, first).when(key % 3 == 1, F.concat(first, F.lit("至"), (key % 20 + 3).cast("string"), F.lit("日"))).otherwise(F.lit("没有日期"))
    return spread(table(spark, sf_dir, "customer").select(key), "c_custkey").select(key, text.alias("text"), F.lit("2025-12-31 10:00:00").cast("timestamp_ntz").alias("published"))


@query(f"""SELECT c_custkey, CAST({_DAY} + CAST(i AS INTEGER) AS VARCHAR) AS day, 'explicit' AS precision FROM customer, range(3) r(i) WHERE c_custkey % 3 = 1 OR c_custkey % 3 = 0 AND i = 0
 UNION ALL SELECT c_custkey, '2025-12-31', 'disclosure_end' FROM customer WHERE c_custkey % 3 = 2""")
def activity_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.activity_dates(_dated(spark, sf_dir), "c_custkey", "text", "published").select("c_custkey", F.col("day").cast("string").alias("day"), "precision")


@query(f"""SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 2 THEN DATE '2025-12-31' ELSE {_DAY} END AS VARCHAR) AS start, CAST(CASE c_custkey % 3 WHEN 2 THEN DATE '2025-12-31' WHEN 0 THEN {_DAY} ELSE {_DAY} + 2 END AS VARCHAR) AS "end",
 {_sql_pick(('explicit_day', 'explicit_range', 'disclosure_day'), 'c_custkey')} AS precision, c_custkey % 3 = 0 AS eligible FROM customer""")
def occurrence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.occurrences(_dated(spark, sf_dir), "c_custkey", "text", "published").select("c_custkey", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "precision", "eligible")


@query(f"""SELECT c_custkey, person, day FROM (SELECT c_custkey, person, d, CAST({_DAY} + CAST(d AS INTEGER) AS VARCHAR) AS day, c_custkey % 2 AS one FROM customer, (VALUES ('甲'), ('乙')) p(person), range(2) r(d) WHERE d = 0 OR c_custkey % 2 = 0)
 WHERE one = 1 OR person = '甲' AND d = 0""")
def participant_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one day or two; the first participant's own line names the first day."""
    key = F.col("c_custkey")
    day = F.make_date(F.lit(2025), (key % 12 + 1).cast("int"), (key % 20 + 1).cast("int"))
    base = table(spark, sf_dir, "customer").select(key, day.alias("day"), F.lit("2025-12-31 10:00:00").cast("timestamp_ntz").alias("published"))
    events = base.select(key, F.explode(F.when(key % 2 == 0, F.array("day", F.date_add("day", 1))).otherwise(F.array("day"))).alias("start"), F.lit(True).alias("eligible"))
    people = base.select(key, "published", F.explode(F.array(F.struct(F.lit("甲").alias("person"), F.date_format("day", "甲 yyyy年M月d日").alias("line")), F.struct(F.lit("乙").alias("person"), F.lit("乙").alias("line")))).alias("p")).select(key, "published", "p.*")
    return research.participant_occurrences(people, events, "c_custkey", "line", "published").select("c_custkey", "person", F.col("start").cast("string").alias("day"))


_NAMES = (("号证券股份有限公司", "号证券", "brokerage", True), ("号 资产管理有限公司", "号资产管理", "asset_management", True), ("号基金管理有限公司", "号基金管理", "public_fund", True), ("号人寿保险（集团）股份有限公司", "号人寿保险集团", "insurance", True), ("ＡＢ Capital Limited", "abcapitallimited", "foreign_institution", True), ("号银行股份有限公司", "号银行", "other", False), ("号钢铁有限公司", "号钢铁", "other", False))


@query(f"""SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) || {_sql_pick([n[1] for n in _NAMES], 's_suppkey')} AS alias, {_sql_pick([n[2] for n in _NAMES], 's_suppkey')} AS kind, s_suppkey % 7 < 5 AS eligible, s_suppkey % 7 = 6 AS own FROM supplier""")
def institution_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in one form, their type, whether they count, and whether they are the company's own."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key, F.concat(key.cast("string"), _pick([n[0] for n in _NAMES], key)).alias("name")).withColumn("alias", research.normalize_institution(F.col("name")))
    rows = rows.withColumn("kind", research.institution_type(F.col("alias")))
    own = research.company_self(F.col("name"), F.array(F.concat(key.cast("string"), F.lit("号钢铁股份有限公司"))))
    return rows.select(key, "alias", "kind", research.eligibility(F.col("name"), F.col("kind"))["eligible"].alias("eligible"), own.alias("own"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '600001' ELSE '600030,600001' END AS codes FROM orders""")
def rater_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stocks = F.array(*(F.struct(F.lit(c).alias("code"), F.lit(n).alias("name")) for c, n in (("600030", "中信证券"), ("600001", "某某股份"))))
    title = _pick(("中信证券给予某某股份买入评级", "中信证券发布年报", "某某股份与中信证券签约"), key)
    kept = X.without_raters(stocks, title, F.lit(""), F.col("o_comment") if "o_comment" in table(spark, sf_dir, "orders").columns else F.lit(""))
    return table(spark, sf_dir, "orders").select(key, F.array_join(F.transform(kept, lambda s: s["code"]), ",").alias("codes"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 9 + 1) * 10000.0::DOUBLE WHEN 2 THEN -(o_orderkey % 9 + 1) * 100000000.0::DOUBLE END AS profit,
 CAST(o_orderkey % 9 + 1 AS VARCHAR) || '0000,' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '00000000' AS amounts, '甲方' || CAST(o_orderkey % 9 + 1 AS VARCHAR) AS targets, CAST(o_orderkey % 9 + 1 AS VARCHAR) || '月3日' AS days, CAST(o_orderkey % 3 AS INTEGER) AS section FROM orders""")
def stated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of net profit, canonical amounts, targets and days, and the section that a mention stands in."""
    key = F.col("o_orderkey")
    said = _filled(["归母净利润为{n}万元", "净利润同比增长{n}%", "净利润-{n}亿元"], key)
    facts = _filled(["客户：甲方{n}，金额{n}万元和{n}亿元、{n}万元，{n}月3日"], key)
    body = _pick(("风险提示\n主要财务数据\n净利润", "净利润", "主要财务数据\n风险提示\n净利润"), key)
    rank = extraction.section_rank(body, F.instr(body, "净利润") - 1)
    return table(spark, sf_dir, "orders").select(key, X.net_profit(said).alias("profit"), F.array_join(X.amounts(facts), ",").alias("amounts"), F.array_join(X.targets(facts), ",").alias("targets"), F.array_join(X.dates_in(facts), ",").alias("days"), rank.alias("section"))


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([folds.indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@query("""SELECT p_partkey, 200.0::DOUBLE * length(p_name) / (2 * length(p_name) + 3 * (p_partkey % 4)) AS ratio FROM part WHERE length(p_name) > 0""")
def indel_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    longer = F.concat("p_name", F.repeat(F.lit("###"), (F.col("p_partkey") % 4).cast("int")))
    return table(spark, sf_dir, "part").where("length(p_name) > 0").select("p_partkey", _indel(F.col("p_name"), longer).alias("ratio"))


@query("""SELECT c_custkey, '<meta charset=utf-8>公告' || c_name AS text, CASE WHEN c_custkey % 2 = 0 THEN 'failed' ELSE 'empty_text' END AS attachment FROM customer""")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their own charset; attachments of an unread kind, and empty ones."""
    raw = F.encode(F.concat(F.lit("<meta charset=utf-8>公告"), F.col("c_name")), "UTF-8")
    file = F.when(F.col("c_custkey") % 2 == 0, F.encode(F.concat(F.lit("%PDF-1.4 "), F.col("c_name")), "UTF-8"))
    return table(spark, sf_dir, "customer").select("c_custkey", feeds.decoded(raw).alias("text"), feeds.attachment_text(file)["status"].alias("attachment"))


@query("""SELECT DISTINCT CAST(year(o_orderdate) + 20 AS VARCHAR) AS year, CAST(make_date(CAST(year(o_orderdate) AS INTEGER) + 20, 2, CAST(o_custkey % 9 + 1 AS INTEGER)) + CAST(i AS INTEGER) AS VARCHAR) AS day FROM orders, range(3) r(i)""")
def closed_day_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("o_custkey") % 9 + 1
    text = F.concat((F.year("o_orderdate") + 20).cast("string"), F.lit("年休市安排：春节：2月"), first.cast("string"), F.lit("日（星期一）至2月"), (first + 2).cast("string"), F.lit("日（星期三）休市，以后照常开市。"))
    return feeds.closed_days(table(spark, sf_dir, "orders").select(text.alias("t")).distinct(), "t").select("year", F.col("day").cast("string").alias("day"))


@query("""SELECT page_id, url, title FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]+</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]+)</a>', 1)) AS title FROM pages) GROUP BY ALL""")
def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of list pages with their titles."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(feeds.anchors("html")).alias("a")).select("page_id", "a.url", "a.title").distinct()


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS rank, r_name AS name, CAST(n AS VARCHAR) || '.00' AS heat FROM region JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY 1) USING (r_regionkey)""")
def csv_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A board written as one CSV file and read again."""
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").cast("double").alias("heat"))
    board = sinks.shown(table(spark, sf_dir, "region").join(n, "r_regionkey"), [("r_regionkey", "rank", ""), ("r_name", "name", ""), ("heat", "heat", "%.2f")])
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    sinks.write_csv(board, path, [F.col("rank")])
    return spark.read.option("header", True).csv(path).toDF("rank", "name", "heat")


@query("""SELECT n_nationkey, n_name, 'fresh' AS state FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT r_regionkey, r_name, 'stale' FROM region""")
def stale_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two boards only one has a newer version: the other's last one stays readable."""
    root, nation = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}", table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.publish({"news": nation, "qa": table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))}, root, 1)
    sinks.publish({"news": nation.where("n_nationkey >= 5"), "qa": None}, root, 2)
    return sinks.read_current(spark, root, "news").withColumn("state", F.lit("fresh")).union(sinks.read_current(spark, root, "qa").withColumn("state", F.lit("stale")))


@query("""SELECT doc_id, quality = 1 AS verified, 0.5::DOUBLE AS certainty FROM labels WHERE quality IS NOT NULL""")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("quality") == 1, "agree").otherwise("disagree")
    merged = table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", scoring.review(outcome, F.lit(0.5)).alias("r"))
    return merged.select("doc_id", "r.verified", "r.certainty")


@query("""SELECT l_orderkey, l_linenumber, o_orderstatus, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def board_view_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with their cluster and its extraction: three tables on their keys."""
    lines, orders, customers = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.select("l_orderkey", "l_linenumber").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"), "l_orderkey")
    return joined.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment")


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def document_facts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what is known of them, if anything."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("""SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its document and the document's cluster."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")).join(nation.select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey")
    return joined.join(region.select("r_regionkey", "r_name"), "r_regionkey").select("s_suppkey", "n_name", "r_name")


@query("""SELECT c_custkey, '600' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN c_custkey % 2 = 0 THEN ',600999' ELSE '' END AS codes, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN '种植业' ELSE '' END AS tags, CASE c_custkey % 3 WHEN 0 THEN '种植业' WHEN 1 THEN c_mktsegment || '概念' ELSE '' END AS concepts,
 CASE WHEN c_custkey % 5 = 0 THEN '同花顺财经' ELSE '证券时报' END AS source, CASE WHEN c_custkey % 4 = 0 THEN '2026-01-01 00:00:00' ELSE '2026-08-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || ' 09:30:00' END AS published_at FROM customer""")
def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks, tags, concepts, source and time of article pages; bylines and brokers that rate don't count as stocks."""
    key = F.col("c_custkey")
    code = F.concat(F.lit("600"), F.lpad((key % 1000).cast("string"), 3, "0"))
    link = F.concat(F.lit('<a data-code="'), code, F.lit('">'), F.col("c_name"), F.lit("("), code, F.lit(")</a>"))
    broker = F.when(key % 2 == 0, '<a data-code="600999">招商证券</a>签约').otherwise('<a data-code="600999">招商证券</a>给予买入评级')
    more = F.when(key % 3 == 0, '<a data-type="hy" data-code="881101">种植业(881101)</a>').when(key % 3 == 1, F.concat(F.lit('<a href="http://q.10jqka.com.cn/gn/885525/">'), F.col("c_mktsegment"), F.lit("概念（885525）</a>"))).otherwise("")
    day = F.lpad((key % 28 + 1).cast("string"), 2, "0")
    time = F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("<time>2026-08-"), day, F.lit(" 09:30</time>")))
    html = F.concat(F.lit('<div class="article-content"><p><a href="https://stockpage.10jqka.com.cn/300033/">同花顺</a>金融研究中心讯</p><p>'), link, broker, more, F.lit("</p></div>"), F.when(key % 5 == 0, "").otherwise("<p>来源：证券时报 编辑</p>"), time)
    read = articles.articles(spread(table(spark, sf_dir, "customer").select(key, "c_name", "c_mktsegment"), "c_custkey").select(key, "c_name", html.alias("html")), "html", F.lit("标题"), F.lit(""), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    joined = lambda c: F.array_join(c, ",").alias
    return read.select(key, joined(F.transform("stocks", lambda s: s["code"]))("codes"), F.col("stocks")[0]["name"].alias("name"), joined(F.col("tags"))("tags"), joined(F.col("concepts"))("concepts"), "source", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("""SELECT 'sse:' || o_orderkey AS record_id, '600' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS code, o_orderstatus || '股份' AS name, o_orderpriority || '？' AS question, CASE WHEN o_orderkey % 2 = 0 THEN '回复' || o_custkey END AS reply,
 CAST(TIMESTAMP '2026-08-05 10:00:00' - to_hours(CAST(o_orderkey % 20 + 1 AS INTEGER)) AS VARCHAR) AS asked_at, CASE WHEN o_orderkey % 2 = 0 THEN '2026-08-04 09:05:00' END AS replied_at FROM orders WHERE o_orderkey % 3 > 0""")
def question_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of feed pages; items without a known code don't count."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit(":"), F.col("o_orderstatus"), F.lit("股份("), F.when(key % 3 == 0, "123456").otherwise(F.concat(F.lit("600"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))), F.lit(") "), F.col("o_orderpriority"), F.lit("？"))
    asked = F.concat(F.lit('<div class="m_feed_detail m_qa_detail"><div class="m_feed_txt">'), text, F.lit('</div><div class="m_feed_from"><span>'), (key % 20 + 1).cast("string"), F.lit("小时前</span></div></div>"))
    answer = F.when(key % 2 == 0, F.concat(F.lit('<div class="m_feed_detail m_qa"><div class="m_feed_txt">回复'), F.col("o_custkey").cast("string"), F.lit('</div><div class="m_feed_from"><span>昨天 9:05</span></div></div>'))).otherwise("")
    html = F.concat(F.lit('<div class="m_feed_item" id="item-'), key.cast("string"), F.lit('">'), asked, answer, F.lit("</div>"))
    pages = spread(table(spark, sf_dir, "orders").select(key, "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey").select(html.alias("html"), F.lit("2026-08-05 10:00:00").cast("timestamp_ntz").alias("now"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return articles.question_feed(pages, "html", "now").select("record_id", "code", "name", "question", "reply", shown("asked_at"), shown("replied_at"))


@query("""SELECT kind || CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN kind = 'irm_ircs:' AND o_custkey % 2 = 1 THEN NULL ELSE CASE o_custkey % 2 WHEN 0 THEN '600001' ELSE '123456' END END AS code, o_orderpriority AS title,
 CASE kind WHEN 'bse_ann:' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ' 00:00:00' ELSE strftime(to_timestamp(1785888000 + o_orderkey) AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d %H:%M:%S') END AS published_at,
 CASE kind WHEN 'irm_ircs:' THEN 'https://static.cninfo.com.cn/f/' || o_orderkey || '.PDF' WHEN 'bse_ann:' THEN 'https://www.bse.cn/d/' || o_orderkey || '.doc' ELSE 'http://live/' || o_orderkey END AS document_url, CASE kind WHEN 'irm_ircs:' THEN 'PDF' WHEN 'bse_ann:' THEN 'DOC' END AS attachment
 FROM orders, (VALUES ('irm_ircs:'), ('bse_ann:'), ('bse_perf:')) k(kind)""")
def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of recorded pages, one item a page, in one shape."""
    key, say = F.col("o_orderkey").cast("string"), F.lit
    code = F.when(F.col("o_custkey") % 2 == 0, "600001").otherwise("123456")
    ms = (F.lit(1785888000000) + F.col("o_orderkey") * 1000).cast("string")
    title = F.concat(say('"'), F.col("o_orderpriority"), say('"'))
    irm = F.concat(say('{"totalRecord": 1, "results": [{"indexId": "'), key, say('", "mainContent": '), title, say(', "stockCode": "'), code, say('", "pubDate": "'), ms, say('", "attachmentUrl": "f/'), key, say('.PDF", "filetype": "pdf"}]}'))
    ann = F.concat(say('cb({"data": {"content": [{"totalElements": 1, "disclosures": [{"disclosureCode": "'), key, say('", "disclosureTitle": '), title, say(', "publishDate": "'), F.date_format("o_orderdate", "yyyy-MM-dd"), say('", "companyCd": "'), code, say('", "destFilePath": "/d/'), key, say('.doc"}]}]}})'))
    perf = F.concat(say('cb([{"listInfo": {"content": [{"id": "'), key, say('", "title": '), title, say(', "stockCode": "'), code, say('", "showDate": {"time": '), ms, say('}, "url1": "http://live/'), key, say('"}]}}])'))
    orders, out = table(spark, sf_dir, "orders"), None
    for read, body in ((listings.irm_ircs, irm), (listings.bse_announcements, ann), (listings.bse_performances, perf)):
        rows = read(orders.select(body.alias("body")), "body")
        out = rows if out is None else out.union(rows)
    return out.select("document_id", "code", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "document_url", "attachment")


@query("""SELECT c_custkey, 1 AS line_no, 4 AS start, CAST(c_custkey AS VARCHAR) || '号证券' AS name, CASE WHEN c_custkey % 2 = 0 THEN '王龙钰' END AS analyst FROM customer
 UNION ALL SELECT c_custkey, 1, CAST(8 + length(CAST(c_custkey AS VARCHAR)) AS INTEGER), '南方基金', NULL FROM customer WHERE c_custkey % 2 = 1
 UNION ALL SELECT c_custkey, 3, CAST(CASE WHEN c_custkey % 2 = 0 THEN 25 ELSE 22 END + length(CAST(c_custkey AS VARCHAR)) AS INTEGER), 'DM Capital Limited', NULL FROM customer""")
def line_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations of all lines, with the analyst of a line that names one."""
    key = F.col("c_custkey")
    rest = F.when(key % 2 == 0, " 王龙钰 分析师").otherwise("、南方基金")
    text = F.concat(F.lit("记录表\n"), key.cast("string"), F.lit("号证券"), rest, F.lit("\n公司称投资。银行\n"), F.lit("DM Capital Limited\n参与单位：某某基金"))
    return participants.line_mentions(spread(table(spark, sf_dir, "customer").select(key), "c_custkey").select(key, text.alias("text")), "c_custkey", "text")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '—' ELSE '金额 ' || CASE p_partkey % 3 WHEN 1 THEN CAST(CAST(p_size AS BIGINT) * 1000 AS VARCHAR) ELSE p_size || '.5' END || ' 元' END AS metric, repeat('反证' || p_size || '；', 2) || 'partial' AS evidence FROM part""")
def shown_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal's first metric and its counter-evidence as a board shows them."""
    size = F.col("p_size").cast("double")
    value = F.when(F.col("p_partkey") % 3 == 1, size * 1000).otherwise(size + 0.5)
    metric = F.struct(F.lit("金额").alias("name"), value.alias("value"), F.lit("元").alias("unit"))
    metrics = F.when(F.col("p_partkey") % 3 > 0, F.array(metric)).otherwise(F.filter(F.array(metric), lambda _: F.lit(False)))
    item = F.struct(F.lit("title_body_conflict").alias("kind"), F.concat(F.lit("反证"), F.col("p_size").cast("string")).alias("summary"))
    evidence = F.array(item, item, F.struct(F.lit("partial").alias("kind"), F.lit("").alias("summary")))
    return table(spark, sf_dir, "part").select("p_partkey", scoring.shown_metric(metrics).alias("metric"), scoring.shown_evidence(evidence).alias("evidence"))


#: What is wrong with an answer, in turn: {x} is a key, {l} a level.
_ANSWERS = (
    '{"event_type": "mna", "direction": "positive", "certainty": 0.9, "materiality_level": {l}, "unexpectedness": 50, "novelty": 60.5, "metrics": [], "counter_evidence": [{"kind": "partial"}], "evidence_ids": ["{x}:1"]}',
    '```{"event_type": "mna"}```',
    '{"event_type": "mna", "direction": "positive", "certainty": 0.9, "materiality_level": {l}.5, "unexpectedness": 50, "novelty": 60, "metrics": [], "counter_evidence": [], "evidence_ids": []}',
    '{"event_type": "mna", "direction": "positive", "certainty": 0.9, "materiality_level": {l}, "unexpectedness": 50, "novelty": 60, "metrics": [{"name": "x"}], "counter_evidence": [], "evidence_ids": []}',
    '{"event_type": "approval", "direction": "neutral", "certainty": 0.5, "materiality_level": {l}, "unexpectedness": 0, "novelty": 100, "metrics": [], "counter_evidence": [], "evidence_ids": ["llm:{x}"], "no_valid_signal": true}',
    '{"event_type": "mna", "direction": "up", "certainty": 0.9, "materiality_level": {l}, "unexpectedness": 50, "novelty": 60, "metrics": [], "counter_evidence": [], "evidence_ids": []}',
    '{"event_type": "mna", "direction": "positive", "certainty": 0.9, "materiality_level": {l}, "unexpectedness": 50, "novelty": 60, "metrics": [], "counter_evidence": [], "evidence_ids": ["other:1"]}',
)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k, CAST(o_custkey % 5 AS INTEGER) AS level, o_custkey % 3 AS c FROM orders)
 SELECT o_orderkey, CASE WHEN c = 0 AND k = 0 THEN 'mna' WHEN c = 0 AND k = 4 THEN 'approval' ELSE 'risk_resolution' END AS event_type, CASE WHEN c = 0 AND k = 0 THEN 'signed' WHEN c = 0 AND k = 4 THEN 'framework' ELSE 'executed' END AS certainty_stage,
 CASE WHEN c = 0 AND k IN (0, 4) THEN level ELSE 1 END AS materiality_level, CASE WHEN c = 0 AND k IN (0, 4) THEN 'llm' ELSE 'rules_fallback' END AS extractor FROM o WHERE c = 0 AND k IN (0, 4) OR o_orderkey % 2 = 0""")
def answered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept answers for two documents in three, of which every other one is of an older text; the rules answer for the rest."""
    key = F.col("o_orderkey")
    text = F.replace(F.replace(_pick(list(_ANSWERS), key), F.lit("{x}"), key.cast("string")), F.lit("{l}"), (F.col("o_custkey") % 5).cast("string"))
    orders = table(spark, sf_dir, "orders").select(key, F.col("o_custkey"), key.cast("string").alias("document_id"), F.md5(F.concat_ws(":", key.cast("string"), F.col("o_orderstatus"))).alias("content_hash"), text.alias("response"))
    stale = F.when(F.col("o_custkey") % 3 == 1, "old").otherwise(F.col("content_hash"))
    cache = orders.where(F.col("o_custkey") % 3 < 2).select("document_id", F.lit("m").alias("model"), F.lit("1").alias("prompt_version"), stale.alias("content_hash"), "response", F.lit(1).alias("answered_at"))
    none = cache.limit(0)
    found = answers.from_cache(orders.drop("response"), answers.to_cache(none, cache), "m", "1").withColumn("v", answers.parsed(F.col("response")))
    read = found.select("o_orderkey", answers.holds(F.col("v"), F.array("document_id")).alias("holds"), answers.fields(F.col("v")).alias("f")).select("o_orderkey", "holds", "f.event_type", "f.certainty_stage", "f.materiality_level")
    ruled = orders.where(key % 2 == 0).select("o_orderkey", F.lit("risk_resolution").alias("event_type"), F.lit("executed").alias("certainty_stage"), F.lit(1).alias("materiality_level"))
    return answers.with_fallback(orders, read, ruled, ["o_orderkey"], ["event_type", "certainty_stage", "materiality_level"])
