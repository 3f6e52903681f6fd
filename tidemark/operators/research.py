"""Records of research activities: dates, questions, participants and who counts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from ..functions.text import first_match

# Patterns and word lists of activity records.
LEGAL_SUFFIX = r"(?:股份有限公司|有限责任公司|股份公司|有限公司|（有限合伙）|\(有限合伙\))$"
NAME_MARKS = r"[\s　，。、；：·．（）()【】\[\]《》<>“”\"'‘’\-—–_/\\&]"
GENERIC = ("个人投资者", "投资者", "个人", "自然人", "本公司", "公司", "共同基金", "机构投资者")
PERSON_ENDS = "(?:先生|女士|经理|总|董事长|总监)$"
MEDIA = r"传媒|媒体|财经|日报|时报|电视|新闻"
LAW, CONSULTING = r"(?i)律师事务所|\b(?:law firm|attorneys?)\b", r"(?i)咨询(?:有限公司|公司|机构)?|顾问(?:有限公司|公司|机构)?|会计师事务所|\b(?:consulting|consultants?)\b"
BANK_ROLE = r"研究(?:部|所|院|中心|团队)|投研(?:部|中心|团队)|证券研究|行业研究"
TRUST_ROLE = r"研究(?:部|所|院|中心|团队)|投研(?:部|中心|团队)|证券投资|权益投资|资产管理|投资管理|自营(?:部|团队)?"
ENGLISH_SUFFIX, ENGLISH_SHAPE = r"(?i)\b(?:limited|ltd\.?)\s*$", r"(?i)\b(?:asset management|investment management|securities|capital|funds?|partners?|investments?|insurance|advisors?|advisory|private equity|global investors|pension)\b"
SERVICES = r"律师事务所|咨询|会计师事务所|传媒|财经|technology|industrial|pharmaceutical|biotech"
TYPES = (
    ("other", r"银行|\bbank\b|信托|\btrust\b"),
    ("foreign_institution", r"capital|asset management|securities|partners|fund|ubs|gic|point72|temasek|blackrock|fidelity|morgan stanley|goldman"),
    ("brokerage", r"证券(?!投资基金)|投行"),
    ("insurance", r"保险|人寿"),
    ("asset_management", r"资产管理|(?:资管|资产|资本)$|^资管"),
    ("private_fund", r"私募|创投|创业投资|风险投资|投资管理|投资合伙企业|(?:投资|资本管理)$"),
    ("public_fund", r"证券投资基金|(?:基金|基金管理)$"),
)
COUNTING = ("brokerage", "public_fund", "private_fund", "insurance", "asset_management", "foreign_institution")
QUESTION = r"(?:问|Q(?:\d+)?|投资者提问)\s*[:：]\s*([^\n]+)"
DEPTHS = (("high", "单位经济|成本拆解|价格拆解|产能释放|客户认证|认证进度|量化|指引|份额变化|良率"), ("medium", "毛利率|订单节奏|产能利用率|库存|客户结构|订单|产能|排产|费用率|现金流"))
TOPICS = (
    ("orders", "订单|合同|签约|中标|预收"),
    ("customers", "客户|认证|导入|份额|下游|绑定"),
    ("capacity", "产能|投产|扩产|利用率|爬坡|达产|排产|交期"),
    ("products", "产品|新品|研发|技术|迭代|型号|量产|良率|发布"),
    ("profitability", "毛利|净利|利润|盈利|费用率|成本|价格|涨价|降价"),
    ("growth", "增长|成长|空间|增速|发展|景气|渗透率|规划"),
    ("risks", "风险|减值|诉讼|合规|竞争加剧|需求下滑|不确定|波动"),
    ("governance", "治理|股东|分红|回购|股权激励|减持|增持|董事会|管理层|关联交易"),
)
ACTIVITIES = (("performance_briefing", "业绩说明会"), ("briefing", "说明会"), ("roadshow", "路演"), ("survey", "调研"), ("site_visit", "参观|考察"))
ANALYST = r"([一-鿿·]{2,4})\s*(?:证券)?\s*(?:分析师|研究员)"
REPORTED = r"约?(\d{1,4})(?:家|位|名)(?:机构|基金公司|基金|投资者|单位)"
LIST_HEAD = r"参与单位|参与机构|参加单位|出席单位|参会机构|参会单位|调研机构|来访单位|接待单位|机构名称|单位名称|投资者名单|机构名单|参与人员|附件清单|参会人员名单|调研名单"
LIST_END = r"时间[:：]?|地点[:：]?|方式[:：]?|日期[:：]?|上市公司接待|接待人|交流内容|主要内容|问答情况|问题[一二三四五六七八九十\d]*\s*[:：]|备注[:：]?|公司简介|会议纪要|问\s*[:：]|答\s*[:：]"
INSTITUTION = r"(?:证券|基金|基金管理|保险|人寿|信托|资产管理|资本管理|投资管理|创业投资|资管|资产|资本|投资|私募|理财|养老|合伙企业|创投|银行|期货|金控|集团|控股|研究院|研究所|公司)$"
DATE_LABEL = r"(?:活动|调研|会议|接待|路演|说明会|交流)?(?:时间|日期)|活动安排|日程安排"
LIST_MARKS = "[^、，,；;|]"
_TO = r"\s*(?:至|—|–|-|～|~|到)\s*"
_DAY = r"(?:(20\d{2})(?:年|[./-]))?(\d{1,2})(?:月|[./-])(\d{1,2})日?"
DATES = r"(?:20\d{2}(?:年|[./-]))?(?<!\d)\d{1,2}(?:月|[./-])\d{1,2}日?(?!\d)(?:" + _TO + r"(?:20\d{2}(?:年|[./-]))?(?:\d{1,2}(?:月|[./-]))?\d{1,2}日?(?!\d))?"


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_institution(name: Column) -> Column:
    """Compatible characters, without one legal suffix, without marks and blanks, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(nfkc(F.coalesce(name, F.lit("")))), LEGAL_SUFFIX, ""), NAME_MARKS, ""))


def institution_type(alias: Column) -> Column:
    return F.coalesce(first_match(F.lower(alias), TYPES), F.lit("other"))


def eligibility(name: Column, kind: Column, context: Column | None = None) -> Column:
    """struct<eligible, reason>: does a named organisation count as a research institution?"""
    both = F.trim(F.concat_ws(" ", name, context)) if context is not None else name
    alias = F.regexp_replace(F.lower(F.trim(name)), NAME_MARKS, "")
    says = lambda ok, why: F.struct(F.lit(ok).alias("eligible"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    person = (alias == "") | alias.rlike(MEDIA) | alias.isin(*GENERIC) | alias.rlike(PERSON_ENDS)
    bank, trust = name.rlike(r"(?i)银行|\bbank\b"), name.rlike(r"(?i)信托|\btrust\b")
    return (
        F.when(person, says(False, "媒体、个人或泛称，不计研究机构广度"))
        .when(both.rlike(LAW), says(False, "律所，仅保留组织明细"))
        .when(both.rlike(CONSULTING), says(False, "咨询/专业服务机构，仅保留组织明细"))
        .when(bank & both.rlike(BANK_ROLE), says(True, "银行明确研究部门"))
        .when(bank, says(False, "银行未明确研究部门"))
        .when(trust & both.rlike(TRUST_ROLE), says(True, "信托明确证券投资/投研角色"))
        .when(trust, says(False, "信托未明确证券投资/投研角色"))
        .when(kind.isin(*COUNTING), says(True, F.concat(F.lit("机构类型："), kind)))
        .when(name.rlike(ENGLISH_SUFFIX) & ~name.rlike(ENGLISH_SHAPE), says(False, "英文 Limited/Ltd 仅为法律后缀，未证明研究机构资格"))
        .when(F.lower(both).rlike(SERVICES), says(False, "非研究类专业服务/产业组织"))
        .otherwise(says(False, "产业公司或其他非研究组织，仅保留明细"))
    )


def questions(text: Column) -> Column:
    """array<struct<question, depth, topic>> of the questions asked."""
    asked = F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUESTION), F.lit(1)), lambda q: F.trim(q)), lambda q: q != "")
    return F.transform(asked, lambda q: F.struct(q.alias("question"), F.coalesce(first_match(q, DEPTHS), F.lit("low")).alias("depth"), F.coalesce(first_match(q, TOPICS), F.lit("other")).alias("topic")))


def activity_kind(text: Column) -> Column:
    return F.coalesce(first_match(text, ACTIVITIES), F.lit("other"))


def analysts(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(ANALYST), F.lit(1))
    return F.filter(names, lambda n: ~n.isin("首席", "资深", "高级", "助理", "证券", "研究", "行业", "研究员", "分析师") & ~n.rlike("[师员长理]$"))


def reported_count(text: Column) -> Column:
    """The largest stated number of participants; null without one."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(REPORTED), F.lit(1)), lambda n: n.cast("int")))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date")


def dates(line: Column, published: Column) -> Column:
    """array<struct<start, end>> of the days and ranges in a line. Without a year it is that of publication, or the year
    before for months more than one ahead. Impossible and reversed dates are left out."""

    def one(found: Column) -> Column:
        first, last = F.regexp_extract(found, "^" + _DAY, 0), F.regexp_extract(found, _TO + r"((?:20\d{2}(?:年|[./-]))?(?:\d{1,2}(?:月|[./-]))?\d{1,2}日?)$", 1)
        get = lambda text, pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("int")
        y1, m1, d1 = (get(first, "^" + _DAY, i) for i in (1, 2, 3))
        y2 = get(last, r"^(20\d{2})", 1)
        m2, d2 = F.coalesce(get(last, r"(\d{1,2})(?:月|[./-])\d{1,2}日?$", 1), m1), F.coalesce(get(last, r"(\d{1,2})日?$", 1), d1)
        guess = F.when(m2 <= F.month(published) + 1, F.year(published)).otherwise(F.year(published) - 1)
        year = F.coalesce(y1, guess)
        return F.struct(_date(year, m1, d1).alias("start"), _date(F.coalesce(y2, year), m2, d2).alias("end"))

    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(DATES), F.lit(0)), one), lambda x: x["start"].isNotNull() & x["end"].isNotNull() & (x["start"] <= x["end"]))


def activity_dates(records: DataFrame, record: str, text: str, published: str) -> DataFrame:
    """(record, day, precision): every day named anywhere in the text, ranges day by day; else the day of publication."""
    found = records.select(record, published, F.explode_outer(dates(F.col(text), F.col(published))).alias("d"))
    days = found.select(record, published, F.explode_outer(F.when(F.col("d").isNotNull(), F.sequence("d.start", "d.end"))).alias("day"))
    stated = days.where("day is not null").select(record, "day").distinct().withColumn("precision", F.lit("explicit"))
    rest = records.select(record, F.col(published).cast("date").alias("day")).join(stated.select(record).distinct(), record, "left_anti").withColumn("precision", F.lit("disclosure_end"))
    return stated.union(rest)


def occurrences(records: DataFrame, record: str, text: str, published: str) -> DataFrame:
    """(record, start, end, precision, eligible, reason, occurrence_id) from labelled date lines only.

    Single days count; ranges stay ranges and don't; dates after publication are dropped; without any, the day of
    publication stands in and doesn't count.
    """
    lines = records.select(record, published, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    labelled = lines.where(F.col("line").rlike(DATE_LABEL)).select(record, published, F.explode(dates(F.col("line"), F.col(published))).alias("d"))
    kept = labelled.where(F.col("d.end") <= F.col(published).cast("date")).select(record, "d.start", "d.end").distinct()
    day = F.col("start") == F.col("end")
    kept = kept.select(record, "start", "end", F.when(day, "explicit_day").otherwise("explicit_range").alias("precision"), day.alias("eligible"), F.when(~day, "仅披露活动区间，未映射到具体活动日").alias("reason"))
    rest = records.select(record, F.col(published).cast("date").alias("start")).join(kept.select(record).distinct(), record, "left_anti")
    rest = rest.select(record, "start", F.col("start").alias("end"), F.lit("disclosure_day").alias("precision"), F.lit(False).alias("eligible"), F.lit("未找到结构化活动日期，仅保留披露日").alias("reason"))
    out = kept.union(rest)
    return out.withColumn("occurrence_id", F.concat(F.lit("occurrence:"), F.substring(F.sha1(F.concat_ws("|", record, "precision", F.col("start").cast("string"), F.col("end").cast("string"))), 1, 16)))


def participants(text: Column) -> Column:
    """The organisations named in a record's list of participants: before a colon, or list items that look like one."""
    region = F.regexp_extract(text, rf"(?s)(?:{LIST_HEAD})[^:：\n]*[:：\n](.*?)(?={LIST_END}|$)", 1)
    items = F.split(F.regexp_replace(region, r"(?m)^\s*\d{1,3}[.、]\s*", ""), r"[、，,；;|\n]+")
    names = F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"[:：].*$", "")))
    before_colon = F.transform(items, lambda x: x.rlike("[:：]"))
    both = F.arrays_zip(names.alias("n"), before_colon.alias("c"))
    good = F.filter(both, lambda x: (F.length(x["n"]) >= 2) & (x["n"].rlike(INSTITUTION) | x["n"].rlike(ENGLISH_SHAPE) | x["c"] & (F.length(x["n"]) <= 20)) & ~x["n"].rlike(REPORTED) & ~x["n"].rlike(LIST_HEAD))
    return F.array_distinct(F.transform(good, lambda x: x["n"]))


def mention_context(line: Column, name: Column) -> Column:
    """The list item of a line that holds a name, not the whole line; the name itself if the line has none."""
    at = F.instr(line, name)
    before = F.regexp_extract(F.substring(line, F.lit(1), at - 1), LIST_MARKS + r"*$", 0)
    after = F.regexp_extract(F.substring(line, at + F.length(name), F.length(line)), "^" + LIST_MARKS + "*", 0)
    item = F.regexp_replace(F.concat(before, name, after), r"^\s+|\s+$", "")
    return F.when((at > 0) & (item != ""), item).otherwise(name)


def assembled(records: DataFrame, record: str, code: str, text: str, published: str, named_in: DataFrame | None = None) -> DataFrame:
    """One row per record: (record, activity_id, code, days, precision, kind, reported, named, question_count,
    high_depth, depth_counts, topic_counts). Named are the eligible organisations of the list, each name form once,
    judged by their own list item. Records without text or code are left out. named_in: (record, names) of the lists,
    as of participants.listed_names, which knows wrapped lists; without it a list's items are taken as they stand.
    """
    rows = records.where((F.trim(F.coalesce(text, F.lit(""))) != "") & F.col(code).isNotNull()).select(record, code, text, published)
    days = activity_dates(rows, record, text, published).groupBy(record).agg(F.array_sort(F.collect_set("day")).alias("days"), F.first("precision").alias("precision"))
    if named_in is None:
        lines = rows.select(record, F.explode(participants(F.col(text))).alias("name"), text)
    else:
        lines = rows.select(record, text).join(named_in.select(record, F.explode("names").alias("name")), record).select(record, "name", text)
    own = F.try_element_at(F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.col("name"))), F.lit(1))
    people = lines.select(record, "name", normalize_institution(F.col("name")).alias("alias"), mention_context(F.coalesce(own, F.col("name")), F.col("name")).alias("context"))
    counts = eligibility(F.col("name"), institution_type(F.col("alias")), F.col("context"))["eligible"]
    named = people.where(counts).groupBy(record).agg(F.count_distinct("alias").alias("named"))
    asked = rows.select(record, code, activity_kind(F.col(text)).alias("kind"), reported_count(F.col(text)).alias("reported"), questions(F.col(text)).alias("q"))
    out = asked.join(days, record).join(named, record, "left")
    tally = lambda field, names: F.map_from_entries(F.transform(F.array(*map(F.lit, names)), lambda k: F.struct(k, F.size(F.filter("q", lambda q: q[field] == k)))))
    activity = F.concat(F.lit("activity:"), F.substring(F.sha1(F.concat_ws("|", record, code)), 1, 16))
    depths = tally("depth", ("low", "medium", "high"))
    topics = F.map_filter(tally("topic", (*(n for n, _ in TOPICS), "other")), lambda _, n: n > 0)
    return out.select(record, activity.alias("activity_id"), code, "days", "precision", "kind", "reported", F.coalesce("named", F.lit(0)).alias("named"), F.size("q").alias("question_count"), depths["high"].alias("high_depth"), depths.alias("depth_counts"), topics.alias("topic_counts"))


def company_self(name: Column, own_names: Column) -> Column:
    """True if a name is one of the company's own, with or without a legal suffix."""
    bare = lambda c: F.regexp_replace(c, LEGAL_SUFFIX, "")
    return F.exists(own_names, lambda o: bare(o) == bare(name))


def participant_occurrences(people: DataFrame, events: DataFrame, record: str, line: str, published: str) -> DataFrame:
    """Participants with the occurrences they were at: the only one, or those of the days in their own line."""
    n = events.groupBy(record).agg(F.count("*").alias("__n"))
    joined = people.join(n, record).join(events, record)
    own = F.exists(dates(F.col(line), F.col(published)), lambda d: (d["start"] == d["end"]) & (d["start"] == F.col("start")))
    return joined.where((F.col("__n") == 1) | F.col("eligible") & own).drop("__n")
