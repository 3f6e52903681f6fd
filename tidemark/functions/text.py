"""Text columns: normal forms, ordered rule classifiers, amounts, trigram cosine."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .places import bound

# Patterns and word lists of the domain's rules.
LEADING_SOURCE = r"^(?:[【\[][^】\]]{1,30}[】\]]|快讯[：:]?|消息[：:]?)"
#: Letters, digits and ideographs are no noise; said first, as the members of the class are tried one by one.
TITLE_NOISE = r"(?![0-9A-Za-z一-鿿])[\s　，,。.!！?？:：;；'\"“”‘’（）()《》<>【】\[\]、·—_-]+"
QUESTION_NOISE = r"[，。！？、；：,.!?;:（）()【】\[\]]+"
TEMPLATES = (
    ("融资融券模板稿", r"获融资买入|获融资卖出|融资余额|融资净买入|融资净卖出"),
    ("ETF资金模板稿", r"持仓该股ETF资金|ETF资金.{0,12}(?:净流入|净流出)"),
    ("固定格式资金流稿", r"主力资金.{0,20}(?:净流入|净流出)|主力净流(?:入|出)"),
    ("股东户数模板稿", r"股东户数|股东总户数"),
    ("批量机构调研稿", r"机构调研记录|(?:证券|基金|资管|投资者).{0,18}调研我司|召开.{0,12}调研"),
    ("大宗交易模板稿", r"发生.{0,12}大宗交易|大宗交易.{0,16}成交"),
)
PRICE_ACTION = r"庄家|主力|游资|盘口|拉升|打压|出货|吸筹|洗盘|砸盘|诱多|诱空|挂单|买卖盘|K线|分时"
JUNK = r"涨停|跌停|翻倍|暴涨|暴跌|梭哈|满仓干|加仓干|稳赚|内幕|荐股|加群|私聊|V信|微信号|扣扣|红包"
FUNDAMENTAL = (
    r"业绩|利润|营收|收入|成本|毛利率|净利率|分红|派息|回购|减持|增持|订单|合同|中标|产能|产量|产品|研发|专利|客户|供应商|股东|股权|重组|收购|并购|出售|投资|扩产|诉讼|仲裁|处罚|风险|"
    r"管理层|董事会|监事会|治理|募集资金|募投|担保|质押|解禁|经营|现金流|负债|存货|应收账款|商誉|减值|税率|补贴|政策|合作|签约|投产|量产|交付"
)
BROKERS = ("中信建投", "中国银河", "中金公司", "国泰海通", "国联民生", "第一创业", "东方财富")
RATING_CUE = r"研报|分析师|评级|投资建议|给予|维持|首次覆盖|目标价|买入|增持|推荐|看好|上调|下调|调高|调低|唱多|唱空|跑赢|优于大市"
REPORT_PERIOD = r"(20\d{2})年(半年度|年度|一季度|二季度|三季度|四季度|半年报|一季报|中报|三季报|年报|季报)"
PERIOD_ALIASES = {"半年报": "半年度", "中报": "半年度", "一季报": "一季度", "二季报": "二季度", "三季报": "三季度", "四季度报告": "四季度", "年报": "年度"}
AMOUNT = r"([+-]?\d[\d,]*\.?\d*)\s*(亿元|万元|元|亿|万)"
UNITS = {"亿元": 1e8, "万元": 1e4, "元": 1.0, "亿": 1e8, "万": 1e4}
PERCENT = r"([+-]?\d[\d,]*\.?\d*)\s*(?:%|个百分点)"
TIMES = r"([+-]?\d[\d,]*\.?\d*)\s*倍"
NET_PROFIT = r"(?:归属于上市公司股东的净利润|归母净利润|净利润)(?:达到|为|是|:)?\s*(?:[（(]\s*元\s*[)）]\s*)?([+-]?[\d,]+\.?\d*)\s*(亿元|万元)?"
DISCOVERY = (
    ("financial_report", ("年报", "半年报", "半年度报告", "年度报告", "一季报", "三季报", "季度报告", "业绩预告", "业绩快报", "财务报告", "财务报表", "审计报告", "主要经营数据", "经营情况简报", "定期报告")),
    ("contract_order", ("重大合同", "合同", "订单", "中标", "签约", "采购协议", "销售合同", "供货", "框架协议", "意向协议", "协议")),
    ("approval_customer", ("获批", "获得批准", "核准", "批复", "注册证", "许可证", "批件", "认证", "客户", "定点", "入选", "备案", "过会", "审核通过")),
    ("capital_action", ("回购", "增持", "减持", "定增", "非公开发行", "可转债", "配股", "发行", "重组", "并购", "收购", "吸收合并", "股权激励", "分红", "派息", "送转", "质押", "解禁")),
    ("capacity_project", ("投产", "扩产", "产能", "项目", "工程", "基地", "产线", "车间", "新设", "投资建设")),
    ("policy_subsidy", ("补贴", "补助", "退税", "税收优惠", "政策", "奖励", "专项资金")),
)


def normalize_title(title: Column, leading: str = LEADING_SOURCE, noise: str = TITLE_NOISE) -> Column:
    """Without one leading source mark, blanks and punctuation, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(title), leading, ""), noise, ""))


def normalize_question(question: Column) -> Column:
    """Without blanks and punctuation, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(question, F.lit("")), r"[\s　]+", ""), QUESTION_NOISE, ""))


def first_match(text: Column, rules) -> Column:
    """The label of the first (label, regex) rule that matches; else null."""
    branches = [F.when(text.rlike(regex), F.lit(label)) for label, regex in rules]
    return F.coalesce(*branches)


def template_reason(title: Column, summary: Column, rules=TEMPLATES) -> Column:
    return first_match(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))), rules)


def noise_reason(question: Column, price_action: str = PRICE_ACTION, fundamental: str = FUNDAMENTAL, junk: str = JUNK) -> Column:
    """Why a question doesn't count: empty, price action without anything fundamental, junk, or one character over and over."""
    text = F.trim(F.coalesce(question, F.lit("")))
    return (
        F.when(F.length(text) < 4, "空内容")
        .when(text.rlike(price_action) & ~text.rlike(fundamental), "纯走势/庄家/盘口")
        .when(text.rlike(junk), "垃圾内容")
        .when(text.rlike(r"(.)\1{9,}"), "无意义重复")
    )


def is_broker(name: Column) -> Column:
    bare = F.regexp_replace(name, r"\s+", "")
    return bare.endswith("证券") | bare.isin(*BROKERS)


def without_raters(stocks: Column, title: Column, summary: Column, body: Column, reach: int = 48, leading: int = 1600) -> Column:
    """The (code, name) structs that aren't brokers named within `reach` characters before a rating cue."""

    def cited(alias: Column, context: Column) -> Column:
        after = F.split(context, F.concat(F.lit("\\Q"), alias, F.lit("\\E")), -1)
        # each piece after the first follows one mention; a piece may end where the next mention begins
        rest = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.size(after), F.lit(2))), lambda i: i <= F.size(after)), lambda i: F.substring(F.call_function("array_join", F.slice(after, i, F.size(after)), alias), F.lit(1), F.lit(reach)))
        return F.exists(rest, lambda x: x.rlike(RATING_CUE))

    contexts = F.array(F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, leading))

    def rater(stock: Column) -> Column:
        name = F.regexp_replace(stock["name"], r"\s+", "")
        return is_broker(stock["name"]) & F.exists(contexts, lambda c: cited(name, c))

    return F.filter(stocks, lambda s: ~rater(s))


def is_share_code(code: Column) -> Column:
    """Six digits of a listed A share."""
    return F.coalesce(code.rlike(r"^(?:6\d{5}|(?:00[0-3]|30[01]|920)\d{3})$"), F.lit(False))


def market_of(code: Column) -> Column:
    """bj for 4, 8 and 92; sh for 5, 6 and 9; sz for 0 to 3; else null."""
    return F.when(code.rlike("^(?:4|8|92)"), "bj").when(code.rlike("^[569]"), "sh").when(code.rlike("^[0-3]"), "sz")


def keyword_class(title: Column, rules=DISCOVERY, override: tuple[str, str, str] | None = ("会计政策", "other_disclosure", "会计政策披露"), other: tuple[str, str] = ("other_disclosure", "其他需核验披露"), reason: str = "标题含“%s”") -> Column:
    """struct<kind, reason> by the first keyword in rule order; an override word comes before all rules."""
    made = lambda kind, why: F.struct(F.lit(kind).alias("kind"), F.lit(why).alias("reason"))
    text = F.trim(F.coalesce(title, F.lit("")))
    tests = [(override[0], made(*override[1:]))] if override else []
    tests += [(w, made(kind, reason.replace("%s", w))) for kind, words in rules for w in words]
    return reduce(lambda rest, t: F.when(F.contains(text, F.lit(t[0])), t[1]).otherwise(rest), reversed(tests), made(*other))


def report_period(title: Column) -> Column:
    """2026-半年度 and the like; null without a period."""
    year, period = F.regexp_extract(title, REPORT_PERIOD, 1), F.regexp_extract(title, REPORT_PERIOD, 2)
    aliases = F.create_map(*(F.lit(x) for kv in PERIOD_ALIASES.items() for x in kv))
    return F.when(F.contains(title, F.lit("年")) & (year != ""), F.concat(year, F.lit("-"), F.coalesce(aliases[period], period)))


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def parse_amount(text: Column, pattern: str = AMOUNT, units: dict[str, float] | None = None) -> Column:
    """struct<yuan, unit, value> of the first amount with a unit; null without one."""
    table = F.create_map(*(F.lit(x) for kv in (units or UNITS).items() for x in kv))

    def made(found: Column) -> Column:
        value, unit = found["value"], found["unit"]
        return F.when(value.isNotNull() & table[unit].isNotNull(), F.struct((value * table[unit]).alias("yuan"), unit.alias("unit"), value.alias("value")))

    # bound, as each use of a value or unit would search the text again
    return bound(F.struct(_number(text, pattern).alias("value"), F.regexp_extract(text, pattern, 2).alias("unit")), made)


def parse_percent(text: Column) -> Column:
    """Per cent and percentage points as a share of one; multiples as they are; null for bare numbers."""
    return F.coalesce(_number(text, PERCENT) / 100.0, _number(text, TIMES))


def net_profit(text: Column) -> Column:
    """Yuan of a stated net profit level; rises against last year don't match."""
    value, unit = _number(text, NET_PROFIT), F.regexp_extract(text, NET_PROFIT, 2)
    return value * F.when(unit == "亿元", 1e8).when(unit == "万元", 1e4).otherwise(1.0)


def _holding(text: Column, words: tuple[str, ...], found: Column) -> Column:
    """found, an array, for a text with one of the words that each match has; without them it is empty and not searched for."""
    return F.when(reduce(or_, (F.contains(text, F.lit(w)) for w in words)), found).when(text.isNotNull(), F.array().cast("array<string>"))


def amounts(text: Column) -> Column:
    """The distinct amounts in yuan, rounded, in order."""
    each = F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0))
    return _holding(text, ("元", "亿", "万"), F.array_distinct(F.transform(each, lambda x: F.format_string("%.0f", parse_amount(x)["yuan"]))))


def dates_in(text: Column) -> Column:
    return _holding(text, ("月",), F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:20\d{2}年)?\d{1,2}月\d{1,2}日"), F.lit(0))))


def targets(text: Column) -> Column:
    """Names after customer, supplier and target words."""
    name = r"[：:为是]?\s*([一-龥A-Za-z0-9]{2,20})"
    kinds = (("客户", "供应商", "合作方"), ("标的", "收购", "并购"))
    each = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?:{'|'.join(words)}){name}"), F.lit(1)) for words in kinds))
    return _holding(text, sum(kinds, ()), F.array_distinct(each))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    n = F.length(text)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))))


def trigram_cosine(left: Column, right: Column) -> Column:
    """Shared trigrams over the root of the product of their numbers; 0 if a side has none. Sides are trigram arrays."""
    both = F.sqrt(F.size(left).cast("double") * F.size(right).cast("double"))
    return F.when(both > 0, F.size(F.array_intersect(left, right)) / both).otherwise(0.0)


def canonical_url(url: Column) -> Column:
    """https, host in lower case, single slashes, no query and no fragment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.lit("https://"), host, F.regexp_replace(path, "/{2,}", "/"))


def sequence_id(seq: Column, url: Column) -> Column:
    """The digits of seq, else those of /c<digits>.shtml, else the URL."""
    return F.coalesce(F.nullif(F.regexp_extract(seq, r"^(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/c(\d+)\.shtml", 1), F.lit("")), url)


def jsonp_body(text: Column) -> Column:
    """What stands between the first and the last round bracket."""
    return F.regexp_extract(text, r"(?s)\((.*)\)", 1)


def evidence_excerpt(text: Column, start: Column, end: Column, radius: int = 60, most: int = 240) -> Column:
    """struct<start, end, excerpt>: a match with its surroundings, blanks collapsed, 0-based offsets."""
    first = F.greatest(F.lit(0), start - radius)
    last = F.least(F.length(text), end + radius)
    return F.struct(first.alias("start"), last.alias("end"), F.substring(F.trim(F.regexp_replace(F.substring(text, first + 1, last - first), r"\s+", " ")), 1, most).alias("excerpt"))


def short_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts, joined by newlines."""
    return F.substring(F.sha1(F.concat_ws("\n", *parts)), 1, 16)


def set_digest(values: Column) -> Column:
    """SHA-256 of the sorted distinct values, joined by newlines."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)
