"""Names in lists of participants: wrapped lines put together again, names found by shape or by a table of known names.

A list is the part of a record behind its heading, up to the next one. Lines below each other that are nothing but
items are one list cut at a column's width, so a name may be broken over two of them. Items are cut at list
separators; an item of up to three Chinese characters of a wrapped list is the first part of the next one. An item may
hold two names (joined by 和, or glued together), a name and a person, or a name and a remark in brackets.

Which parts of an item are known is asked once for all distinct items: each emits the parts that a cut could leave,
and these are joined to the known names. So the table of names may have any size, and no item is compared with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .research import GENERIC, LIST_HEAD, MEDIA, PERSON_ENDS, analysts, normalize_institution

# Patterns and word lists of participant lists.
ENDINGS = "证券股份有限公司|证券有限责任公司|证券有限公司|证券股份|证券|基金管理有限责任公司|基金管理有限公司|基金管理|基金|保险(?:集团)?股份有限公司|保险有限公司|保险|人寿|信托|资产管理有限责任公司|资产管理有限公司|资产管理|资本管理|投资管理|创业投资|资管|资产|资本|投资|私募|理财|养老|有限合伙|合伙企业|创投|科技|生物|医药|实业|材料|银行|期货|租赁|金控|集团|控股|研究(?:院|所)|分公司|自营部|自营|（有限合伙）|\\(有限合伙\\)|股份有限公司|有限责任公司|有限公司|公司"
SHORT_ENDINGS = "证券|基金管理|基金|保险|资管|资产|资本|投资|信托|理财|养老|集团|控股|银行|研究(?:院|所)"
ENGLISH_ENDINGS = "Asset Management|Investment Management|Securities|Investments|Investment|Capital|Funds?|Partners|Partnership|Bank|Insurance|Trust|Advisors?|Advisory|Management|Group|Holdings|Limited|Ltd|Global Investors|Ventures|Equity|Private Equity|Hong Kong|Financial|Corporation|Corp|Pension|Asset|LTD|LLC|INC"
META = "记录表|时间|方式|地点|日期|参与单位|单位名称|交流内容|公司简介|证券代码|股票代码|公告编号|活动安排|参加单位|出席单位|调研单位|来访单位|参会单位|机构名称|接待单位|参与机构|名单|附件|出席|到场|接待|调研机构"
REGION_END = "时间(?!(?:先后|顺序)|及?参与)[:：]?|地点[:：]?|方式[:：]?|日期[:：]?|上市公司接待|接待人员?(?:\\s*姓名)?|交流内容|主要内容|问答情况|投资者提出的主要问题|问题[一二三四五六七八九十\\d]*\\s*[:：]|投资者关系活动[：:]|备注[:：]?|以下为|公司简介|业务介绍|公司介绍|座谈交流|会议纪要|问\\s*[:：]|答\\s*[:：]"
NO_NAME = "公司|本公司|上市公司|上述|该|相关|以及|成为|结合|围绕|主要|在|与|及|对|为|的|是|有|向|从|将|就|以|于|根据|由|目前|此外|另外|其中|比如|例如|旗下|包括|包含|通过|借助|依托|基于|涉及|是否|参与|接待|实现|凭借|开始|同时|并|且|或|还|已|未|拟|其他|短期|具体|关于|获得|（|\\(|参与单位|单位名称|参会机构|参会单位|附件清单|详见附件|见附件|详见|见|面向|全体|采用|线上|网络远程|活动形式|活动暨|问题|请问|回答|本次|序号"
TITLES = "先生|女士|老师|分析师|研究员|经理|总监|董事长|总经理|秘书|董事|监事|主任|主管|行长|会计师|总会计师|部长|总经理助理|事务代表|负责人|总裁|副总裁|副董事长|独立董事"
VAGUE = "等|机构|投资者|基金公司|家|位|名|人"
VAGUE_END = "(?:等\\d{1,4}家机构\\d{1,4}人|等\\d{1,4}家机构|等机构的?\\d{1,4}位投资者|等\\d{1,4}位投资者|等机构|等\\d{1,4}人|(?:近|约|共)\\d{1,4}位(?:机构)?投资者(?:人员)?|及其他?(?:线上)?参会的?(?:个人|其他)?投资者|及个人投资者等?|等其他(?:机构|投资者)?|等其他参会的?(?:个人|其他)?投资者)[。！？!?]*$"
AND_BRANDS = "和风|和信|和聚|和君|和泰|和润"

HAN = "[\\u4e00-\\u9fff]"
_NAME_CHARS = "[\\u4e00-\\u9fffA-Za-z0-9（）()·＆&]"
_ITEMS = f"(?![^\\n]*(?:{META}))[^\\n：:。！？]*"
#: Lines of nothing but items, of which the first has a list separator and the others have one or are short.
WRAPPED = f"(?=[^\\n]*、)(?=[^\\n]*\\S){_ITEMS}(?:\\n(?=[^\\n]*、|\\s*[^\\n]{{1,40}}\\s*(?:\\n|$))(?=[^\\n]*\\S){_ITEMS}(?=\\n|$))+"
SHAPE = f"^{_NAME_CHARS}{{2,24}}(?:{ENDINGS})$"
ENGLISH = f"^[A-Za-z0-9][A-Za-z0-9 .&'·()（）-]{{1,60}}(?:{ENGLISH_ENDINGS})(?:\\.?(?:Co|Inc|LLC|LP|PLC))?$"
WITH_PERSON = f"^({_NAME_CHARS}{{2,20}}?(?:{SHORT_ENDINGS}))\\s*{HAN}{{1,4}}$"
SEPARATORS = "[、，,；;|]+"
MARK, MOST_ITEM = "\\s*\\d{1,3}[.、]\\s*|\\s*\\d{1,3}\\s+(?=\\D)", 64


def list_lines(text: Column) -> Column:
    """The lines of a record's list of participants; those of a wrapped list as one, with its line breaks."""
    region = F.regexp_extract(text, rf"(?s)(?:{LIST_HEAD})[^:：\n]*[:：\n]+(.*?)(?={REGION_END}|$)", 1)
    return F.filter(F.regexp_extract_all(region, F.lit(f"{WRAPPED}|[^\\n]+"), F.lit(0)), lambda x: F.trim(x) != "")


def _joined(line: Column) -> Column:
    """A line without blanks but for those between Latin words."""
    return F.regexp_replace(F.regexp_replace(line, r"(?<=[A-Za-z0-9.&'-])\s+(?=[A-Za-z0-9&(])", "\u0001"), r"\s+", "")


def list_items(line: Column) -> Column:
    """The items of a line, first parts of broken names put before the rest."""
    plain = lambda x: F.replace(x, F.lit("\u0001"), F.lit(" "))
    cut = lambda x: F.filter(F.transform(F.split(x, SEPARATORS), lambda i: F.trim(plain(i))), lambda i: i != "")
    none = F.array().cast("array<string>")
    wrapped = F.aggregate(
        cut(_joined(line)),
        F.struct(none.alias("done"), F.lit("").alias("held")),
        lambda acc, x: F.when(acc["held"] != "", F.struct(F.concat(acc["done"], F.array(F.concat(acc["held"], x))).alias("done"), F.lit("").alias("held")))
        .when(x.rlike(f"^{HAN}{{1,3}}$"), F.struct(acc["done"].alias("done"), x.alias("held")))
        .otherwise(F.struct(F.concat(acc["done"], F.array(x)).alias("done"), F.lit("").alias("held"))),
        lambda acc: F.when(acc["held"] != "", F.concat(acc["done"], F.array(acc["held"]))).otherwise(acc["done"]),
    )
    before_colons = F.regexp_extract_all(line, F.lit(f"((?:[A-Za-z0-9.&'-]{{1,20}} )*{_NAME_CHARS}{{2,20}})\\s*[：:]"), F.lit(1))
    # in a line of its own, blanks between Chinese words part columns
    columns = cut(F.regexp_replace(F.regexp_replace(line, f"^(?:{MARK})", ""), f"(?<={HAN})\\s+|\\s+(?={HAN})", "、"))
    return F.when(line.rlike(r"\n"), wrapped).when(line.rlike("[:：]"), before_colons).otherwise(columns)


def _from(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(n + 1), F.length(x))


def _cleaned(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, VAGUE_END, ""), f"^(?!{AND_BRANDS})[和与及]+", "")


def _base(x: Column) -> Column:
    """What stands before a remark in brackets."""
    return F.trim(F.regexp_extract(x, r"^[^（(]*", 0))


def _parts(item: Column) -> Column:
    """All parts of an item that a cut could leave."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(item), F.lit(1))), lambda i: F.substring(item, i, F.lit(1)) == "和")
    halves = F.flatten(F.transform(at, lambda i: F.array(F.substring(item, F.lit(1), i - 1), F.substring(item, i + 1, F.length(item)))))
    pieces = F.concat(F.array(item), halves)

    def of(p: Column) -> Column:
        clean = _cleaned(p)
        ends = [F.substring(x, F.lit(1), F.length(x) - k) for x in (clean, _base(clean)) for k in (1, 2, 3, 4)]
        return F.array(p, clean, _base(clean), *(_from(p, k) for k in (2, 3, 4)), *(_cleaned(_from(p, k)) for k in (2, 3, 4)), *(F.substring(p, 1, k) for k in (2, 3, 4)), *ends)

    return F.filter(F.array_distinct(F.flatten(F.transform(pieces, of))), lambda x: F.length(x) >= 2)


def _names(item: Column, known: Column) -> Column:
    """array<struct<name, how>>: the names of an item, given which of its parts are known."""
    is_known = lambda x: F.array_contains(known, x)
    sure = lambda x: x.rlike(SHAPE) | is_known(x)
    fair = lambda x: sure(x) | F.length(x).between(3, 4)
    rest = _from(item, 1)
    left, right = lambda i: F.substring(item, F.lit(1), i - 1), lambda i: F.substring(item, i + 1, F.length(item))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(item), F.lit(1))), lambda i: (F.substring(item, i, F.lit(1)) == "和") & (i > 1) & (i < F.length(item)) & fair(left(i)) & fair(right(i)))
    first = F.try_element_at(at, F.lit(1))
    pieces = F.when(item.startswith("和") & ~item.rlike(f"^(?:{AND_BRANDS})") & sure(rest), F.array(rest)).when(first.isNotNull(), F.array(left(first), right(first))).otherwise(F.array(item))

    def unglued(p: Column) -> Column:
        out = F.array(p)
        for k in (4, 3, 2):  # the longest known name at the end wins
            tail = _from(p, k)
            out = F.when((F.length(tail) >= 3) & is_known(tail) & F.substring(p, 1, k).rlike(f"^{HAN}{{{k}}}$"), F.array(F.substring(p, 1, k), tail)).otherwise(out)
        return F.when(is_known(p), F.array(p)).otherwise(out)

    def judged(p: Column) -> Column:
        says = lambda name, how: F.struct(name.alias("name"), F.lit(how).alias("how"))
        person = lambda x: F.nullif(F.regexp_extract(x, WITH_PERSON, 1), F.lit(""))

        def known_and_person(x: Column) -> Column:
            best = F.lit(None).cast("string")
            for k in (4, 3, 2, 1):
                head = F.substring(x, F.lit(1), F.length(x) - k)
                best = F.when((F.length(head) >= 3) & is_known(head) & x.rlike(f"{HAN}{{{k}}}$"), head).otherwise(best)
            return best

        clean = _cleaned(p)
        base, bad = _base(clean), clean.rlike(f"^(?:{NO_NAME})") | clean.rlike(f"(?:{TITLES})$")
        with_person = lambda x: F.coalesce(person(x), known_and_person(x))
        return (
            F.when(is_known(clean), says(clean, "known"))
            .when(clean.rlike(f"^(?:{NO_NAME})"), says(F.lit(None).cast("string"), "none"))
            .when(clean.rlike(SHAPE) | clean.rlike(ENGLISH), says(clean, "shape"))
            .when(F.length(clean).between(3, 4) & ~bad & clean.rlike(f"^{_NAME_CHARS}+$"), says(clean, "bare"))
            .when(with_person(clean).isNotNull(), says(with_person(clean), "person"))
            .when(base.rlike(SHAPE) | is_known(base), says(base, "remark"))
            .when(with_person(base).isNotNull(), says(with_person(base), "remark"))
            .when(clean.rlike("[A-Za-z]") & ~clean.rlike(f"{HAN}{{2}}") & F.length(clean).between(2, 60), says(clean, "latin"))
            .when(F.length(clean).between(5, 12) & ~bad & ~clean.rlike(VAGUE), says(clean, "long"))
            .otherwise(says(F.lit(None).cast("string"), "none"))
        )

    return F.filter(F.transform(F.flatten(F.transform(pieces, unglued)), judged), lambda x: x["name"].isNotNull())


def listed_names(records: DataFrame, record: str, text: str, known: DataFrame, alias: str) -> DataFrame:
    """(record, names): the organisations in each record's list of participants, in order, each once.

    known holds names in the form of normalize_institution. A name without a known form or a telling ending is taken
    if it has three or four characters; not in a line that has columns or names with persons, where it is likely a
    person's. Before a colon up to twelve characters do, and Latin names without an ending in lists with commas. Items
    over MOST_ITEM characters are prose. Records without a list have no row.
    """
    lines = records.select(record, F.posexplode(list_lines(F.col(text))).alias("line_no", "line"))
    rows = lines.withColumns({"wrapped": F.col("line").rlike(r"\n"), "colon": F.col("line").rlike("[:：]"), "columns": F.col("line").rlike(f"{HAN}\\s+{HAN}"), "commas": F.col("line").rlike("[A-Za-z0-9],\\s*[A-Za-z]")})
    items = rows.select(record, "line_no", "wrapped", "colon", "columns", "commas", F.posexplode(list_items(F.col("line"))).alias("item_no", "item")).where(F.length("item") <= MOST_ITEM)
    distinct = items.select("item").distinct()
    parts = distinct.select("item", F.explode(_parts(F.col("item"))).alias("part"))
    found = parts.withColumn("form", normalize_institution(F.col("part"))).join(known.select(F.col(alias).alias("form")).distinct(), "form").groupBy("item").agg(F.collect_set("part").alias("known"))
    judged = distinct.join(found, "item", "left").select("item", _names(F.col("item"), F.coalesce("known", F.array().cast("array<string>"))).alias("found"))
    flags = ["wrapped", "colon", "columns", "commas"]
    by_line = items.join(judged, "item").groupBy(record, "line_no", *flags).agg(F.array_sort(F.collect_list(F.struct("item_no", "found"))).alias("items"))
    all_found = F.flatten(F.transform("items", lambda x: x["found"]))
    with_persons = F.exists(all_found, lambda x: x["how"] == "person") & ~F.col("wrapped")
    bare = F.col("wrapped") | F.col("colon") | ~(F.col("columns") | with_persons)
    kept = F.filter(all_found, lambda x: x["how"].isin("known", "shape", "person", "remark") | ((x["how"] == "bare") & bare) | ((x["how"] == "latin") & (F.col("commas") | F.col("colon"))) | ((x["how"] == "long") & F.col("colon")))
    named = by_line.select(record, "line_no", F.transform(kept, lambda x: x["name"]).alias("names"))
    whole = named.groupBy(record).agg(F.array_sort(F.collect_list(F.struct("line_no", "names"))).alias("lines"))
    return whole.select(record, F.array_distinct(F.flatten(F.transform("lines", lambda x: x["names"]))).alias("names"))


# Endings of the older reading, which takes names from all lines of a text.
OLD_ENDINGS = "证券股份有限公司|证券有限责任公司|证券有限公司|证券股份|证券|基金管理有限责任公司|基金管理有限公司|基金管理|基金|保险(?:集团)?股份有限公司|保险有限公司|保险|人寿|信托|资产管理有限责任公司|资产管理有限公司|资产管理|资本管理|投资管理|创业投资|资管|银行|期货|租赁|金控|集团|控股|研究(?:院|所)|股份有限公司|有限责任公司|有限公司|公司"
OLD_META, HINTS = "记录表|时间|方式|地点|日期|参与单位|单位名称|交流内容|公司简介|证券代码|股票代码|公告编号|活动安排", "参与机构|参加单位|出席单位|机构名称|名单|附件|出席|到场|接待|调研机构"
_BEHIND = "(?<=^|[、，,；;：: \\t(（【])"
OLD_NAME = f"{_BEHIND}{_NAME_CHARS}{{2,24}}(?:{OLD_ENDINGS})(?![\\u4e00-\\u9fffA-Za-z0-9])"
OLD_ENGLISH = f"{_BEHIND}[A-Za-z][A-Za-z0-9 .&'·-]{{1,60}}(?:{ENGLISH_ENDINGS})(?:\\.?(?:Co|Inc|LLC|LP|PLC))?(?![A-Za-z0-9])"
LONGEST, LONGEST_ENGLISH = 20, 60


def line_mentions(records: DataFrame, record: str, text: str) -> DataFrame:
    """(record, line_no, start, name, analyst): organisations in any line of a text, each once, where it stands first.

    The older reading: it knows no lists. Lines of labels are left out, and lines of prose without a word of lists.
    start is the name's place in the text. The first analyst of a line belongs to its name if it has only one.
    """
    lines = F.split(F.col(text), "\n", -1)
    rows = records.where(F.col(text).isNotNull()).select(record, lines.alias("lines")).select(record, "lines", F.posexplode("lines").alias("line_no", "line"))
    # the line breaks before a line count as well
    before = F.length(F.array_join(F.slice("lines", 1, F.col("line_no")), "\n")) + F.when(F.col("line_no") > 0, 1).otherwise(0)
    rows = rows.where(~F.col("line").rlike(OLD_META) & (~F.col("line").rlike("[。！？]") | F.col("line").rlike(HINTS))).withColumn("before", before)
    found = F.array_distinct(F.transform(F.concat(F.regexp_extract_all("line", F.lit(OLD_NAME), F.lit(0)), F.regexp_extract_all("line", F.lit(OLD_ENGLISH), F.lit(0))), lambda x: F.trim(x)))
    rows = rows.withColumn("names", found).where(F.size("names") > 0)
    analyst = F.when(F.size("names") == 1, F.try_element_at(analysts(F.col("line")), F.lit(1)))
    named = rows.select(record, "line_no", "line", "before", analyst.alias("analyst"), F.explode("names").alias("name"))
    latin = F.col("name").rlike("^[A-Za-z]")
    fair = (F.length("name") <= LONGEST) | (latin & (F.length("name") <= LONGEST_ENGLISH))
    kept = named.where(fair & ~F.col("name").rlike(f"^(?:{NO_NAME})")).withColumn("form", normalize_institution(F.col("name")))
    kept = kept.where((F.col("form") != "") & ~F.col("name").rlike(MEDIA) & ~F.col("form").isin(*GENERIC) & ~F.col("name").rlike(PERSON_ENDS))
    start = (F.col("before") + F.instr("line", F.col("name")) - 1).alias("start")
    first = kept.select(record, "form", F.struct("line_no", start, "name", "analyst").alias("m")).groupBy(record, "form").agg(F.min("m").alias("m"))
    return first.select(record, "m.line_no", "m.start", "m.name", "m.analyst")
