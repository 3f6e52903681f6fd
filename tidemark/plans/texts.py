"""Text rules on documents, pages, conversations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins
from . import query, table

_TITLE = r"[\s,.!?:;''()<>\[\]_-]+"


@query(r"""
SELECT doc_id, lower(regexp_replace(regexp_replace(trim(split_part(text, chr(10), 1)), '^(?:[【\[][^】\]]{1,30}[】\]]|快讯[：:]?|消息[：:]?)', ''), '[\s　，,。.!！?？:：;；''"“”‘’（）()《》<>【】\[\]、·—_-]+', '', 'g')) AS title FROM documents
""")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"))


@query(r"""
SELECT conv_id, turn, md5(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[\s　]+', '', 'g'), '[，。！？、；：,.!?;:（）()【】\[\]]+', '', 'g'))) AS question FROM conversations
""")
def normalize_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.normalize_question(F.col("text"))).alias("question"))


_KINDS = (("licensed", r"[Ll]icen[cs]ed? under"), ("token", r"token = "), ("phone", r"\+1 \(\d{3}\)"), ("mail", r"\d+@mail\d"), ("shout", r"!! [A-Z]+!!"), ("table", r" \| "))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '[Ll]icen[cs]ed? under') THEN 'licensed' WHEN regexp_matches(text, 'token = ') THEN 'token' WHEN regexp_matches(text, '\+1 \(\d{3}\)') THEN 'phone'
  WHEN regexp_matches(text, '\d+@mail\d') THEN 'mail' WHEN regexp_matches(text, '!! [A-Z]+!!') THEN 'shout' WHEN regexp_matches(text, ' \| ') THEN 'table' END AS reason FROM documents
""")
def template_filter_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.template_reason(F.lit(""), F.col("text"), _KINDS).alias("reason"))


@query(r"""
SELECT conv_id, turn, CASE WHEN length(trim(text)) < 4 THEN '空内容' WHEN regexp_matches(text, 'then|with') AND NOT regexp_matches(text, 'ing|tion') THEN '纯走势/庄家/盘口' WHEN regexp_matches(text, 'idiot|pathetic|worthless') THEN '垃圾内容'
  WHEN regexp_matches(text, 'a{10}|b{10}|c{10}|e{10}|!{10}|\.{10}') THEN '无意义重复' END AS reason FROM conversations
""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = X.noise_reason(F.col("text"), "then|with", "ing|tion", "idiot|pathetic|worthless")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


@query("""
SELECT o_orderkey, lpad(CAST(o_orderkey * 37 % 1000000 AS VARCHAR), 6, '0') AS code, regexp_matches(lpad(CAST(o_orderkey * 37 % 1000000 AS VARCHAR), 6, '0'), '^(?:6\\d{5}|(?:00[0-3]|30[01]|920)\\d{3})$') AS is_share FROM orders
""".replace("\\\\", "\\"))
def code_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("o_orderkey") * 37 % 1_000_000).cast("string"), 6, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).withColumn("is_share", X.is_share_code(F.col("code")))


@query("""
SELECT o_orderkey, CASE WHEN code[1] IN ('4', '8') OR code[1:2] = '92' THEN 'bj' WHEN code[1] IN ('5', '6', '9') THEN 'sh' WHEN code[1] IN ('0', '1', '2', '3') THEN 'sz' END AS market
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS code FROM orders)
""")
def market_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lpad((F.col("o_orderkey") * 7919 % 1_000_000).cast("string"), 6, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.market_of(code).alias("market"))


_RULES = (("legal", ("License", "licensed")), ("privacy", ("token", "@mail", "555-")), ("english", (" the ", " and ")), ("french", (" les ", " une ")), ("german", (" der ", " und ")))


@query("""
SELECT doc_id, CASE WHEN contains(text, 'idiot') THEN 'rude' WHEN contains(text, 'License') OR contains(text, 'licensed') THEN 'legal' WHEN contains(text, 'token') OR contains(text, '@mail') OR contains(text, '555-') THEN 'privacy'
  WHEN contains(text, ' the ') OR contains(text, ' and ') THEN 'english' WHEN contains(text, ' les ') OR contains(text, ' une ') THEN 'french' WHEN contains(text, ' der ') OR contains(text, ' und ') THEN 'german' ELSE 'other' END AS kind,
  CASE WHEN contains(text, 'idiot') THEN 'override' WHEN contains(text, 'License') THEN 'has License' WHEN contains(text, 'licensed') THEN 'has licensed' WHEN contains(text, 'token') THEN 'has token' WHEN contains(text, '@mail') THEN 'has @mail' WHEN contains(text, '555-') THEN 'has 555-'
  WHEN contains(text, ' the ') THEN 'has  the ' WHEN contains(text, ' and ') THEN 'has  and ' WHEN contains(text, ' les ') THEN 'has  les ' WHEN contains(text, ' une ') THEN 'has  une ' WHEN contains(text, ' der ') THEN 'has  der ' WHEN contains(text, ' und ') THEN 'has  und ' ELSE 'none' END AS reason
FROM documents
""")
def keyword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = X.keyword_class(F.col("text"), _RULES, ("idiot", "rude", "override"), ("other", "none"), "has %s")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("k")).select("doc_id", "k.kind", "k.reason")


@query("""
SELECT l_orderkey, l_linenumber, CAST(value AS DOUBLE) * CASE unit WHEN '亿元' THEN 1e8 WHEN '万元' THEN 1e4 ELSE 1.0 END AS yuan, unit, CAST(value AS DOUBLE) AS value
FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) AS value, CASE l_linenumber % 3 WHEN 0 THEN '亿元' WHEN 1 THEN '万元' ELSE '元' END AS unit FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem))
""")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 3 == 0, "亿元").when(F.col("l_linenumber") % 3 == 1, "万元").otherwise("元")
    said = F.concat(F.lit("合同金额约 "), F.regexp_replace(F.floor("l_extendedprice").cast("string"), r"(\d)(\d{3})$", "$1,$2"), F.lit(" "), unit, F.lit("，同比5%"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.parse_amount(said).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "a.yuan", "a.unit", "a.value")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CAST(q AS DOUBLE) / 100.0 WHEN 1 THEN CAST(q AS DOUBLE) END AS ratio FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
""")
def percent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    said = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("增长"), q, F.lit(" %"))).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("增长"), q, F.lit("倍"))).otherwise(q)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.parse_percent(said).alias("ratio"))


@query("""
SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-' || CASE o_orderkey % 4 WHEN 0 THEN '半年度' WHEN 1 THEN '年度' WHEN 2 THEN '一季度' ELSE '半年度' END AS period FROM orders WHERE year(o_orderdate) >= 2000
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE year(o_orderdate) < 2000
""")
def report_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("o_orderkey") % 4 == 0, "半年报").when(F.col("o_orderkey") % 4 == 1, "年报").when(F.col("o_orderkey") % 4 == 2, "一季报").otherwise("中报")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.report_period(F.concat(F.year("o_orderdate").cast("string"), F.lit("年"), word, F.lit("摘要"))).alias("period"))


@query("""
SELECT page_id, 'https://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS url FROM pages
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"))


@query("""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) WHEN page_id % 3 = 0 THEN CAST(page_id * 7 AS VARCHAR) ELSE url END AS seq FROM pages
""")
def seq_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    seq = F.when(i % 2 == 0, i.cast("string")).otherwise(F.lit("x1"))
    url = F.when(i % 3 == 0, F.concat(F.lit("http://h/c"), (i * 7).cast("string"), F.lit(".shtml"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", X.sequence_id(seq, url).alias("seq"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
""")
def jsonp_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = X.jsonp_body(F.concat(F.lit("callback123("), F.col("props"), F.lit(");")))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(body, "k long", {"mode": "FAILFAST"})["k"].alias("k"))


@query("""
WITH g AS (SELECT DISTINCT p_brand, p_type, p_name, list_distinct([substr(p_name, CAST(i AS INTEGER), 3) for i in range(1, length(p_name) - 1)]) AS g FROM part)
SELECT p_brand, p_type, a, b, cosine FROM (SELECT a.p_brand, a.p_type, a.p_name AS a, b.p_name AS b, len(list_intersect(a.g, b.g)) / sqrt(CAST(len(a.g) AS DOUBLE) * CAST(len(b.g) AS DOUBLE)) AS cosine
FROM g a JOIN g b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_name < b.p_name WHERE len(a.g) > 0 AND len(b.g) > 0) WHERE cosine >= 0.5 - 1e-12
""")
def trigram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the distinct names of a brand and type: parts of one name are one side."""
    grams = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", X.trigrams(F.col("p_name")).alias("g"))
    return joins.alike_pairs(grams, ["p_brand", "p_type"], "p_name", "g", 0.5)


@query("""
WITH p AS (SELECT DISTINCT p_brand, p_size, p_name FROM part)
SELECT a.p_brand, a.p_size, a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 3
""")
def edit_distance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the distinct names of a brand and size: parts of one name are one side."""
    return joins.edit_pairs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_name", 3)


@query("""
SELECT source, count(DISTINCT doc_id) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS digest FROM documents GROUP BY source
""")
def day_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("id"))
    return docs.groupBy("source").agg(F.count_distinct("id").alias("n"), X.set_digest(F.collect_set("id")).alias("digest"))


@query(r"""
SELECT doc_id, sha1(substr(trim(regexp_replace(substr(text, greatest(0, p - 61) + 1, least(length(text), p + 3 + 60) - greatest(0, p - 61)), '\s+', ' ', 'g')), 1, 240)) AS excerpt, greatest(0, p - 61) AS start
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text, instr(replace(text, chr(10), ' '), ' the') AS p FROM documents) WHERE p > 0
""")
def evidence_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    rows = table(spark, sf_dir, "documents").select("doc_id", flat.alias("text")).withColumn("p", F.instr("text", " the")).where("p > 0")
    found = rows.withColumn("e", X.evidence_excerpt(F.col("text"), F.col("p") - 1, F.col("p") + 3))
    return found.select("doc_id", F.sha1("e.excerpt").alias("excerpt"), F.col("e.start").cast("long").alias("start"))
