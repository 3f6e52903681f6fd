"""Scores, gates and states of signals, on line items as extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scoring as S
from . import query, table
from .session import cut

_EXTRACTIONS = """WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 5 WHEN 0 THEN 'cninfo' WHEN 1 THEN 'sse' WHEN 2 THEN 'irm' WHEN 3 THEN 'ths' ELSE 'bse' END AS provider,
 CAST(l_partkey % 5 AS INTEGER) AS level, CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 ELSE 0.45 END::DOUBLE AS certainty, CASE l_suppkey % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 75.0 WHEN 2 THEN 50.0 ELSE 25.0 END::DOUBLE AS unexpectedness,
 CASE l_partkey % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 60.0 ELSE 30.0 END::DOUBLE AS novelty, l_quantity * 2.0 AS timeliness, l_returnflag = 'R' AS partial, l_linestatus = 'O' AND l_partkey % 11 = 0 AS uncertain, l_suppkey % 2 = 0 AS has_history FROM lineitem),
p AS (SELECT *, CASE provider WHEN 'cninfo' THEN 1.0 WHEN 'sse' THEN 0.9 WHEN 'irm' THEN 0.9 ELSE 0.6 END::DOUBLE AS confidence, least(CASE WHEN partial THEN 15.0 ELSE 0 END + CASE WHEN uncertain THEN 35.0 ELSE 0 END + CASE WHEN unexpectedness = 25.0 THEN 20.0 ELSE 0 END + CASE WHEN level = 0 THEN 20.0 ELSE 0 END + CASE WHEN novelty = 30.0 AND has_history THEN 40.0 ELSE 0 END, 80.0)::DOUBLE AS penalty FROM x),
s AS (SELECT *, least(confidence, certainty) * (0.35::DOUBLE * (level * 25.0::DOUBLE) + 0.25::DOUBLE * unexpectedness + 0.2::DOUBLE * novelty + 0.2::DOUBLE * timeliness) - penalty AS score FROM p),
b AS (SELECT *, CASE WHEN level >= 2 AND certainty >= 0.7 AND NOT uncertain AND score >= 60 THEN 'confirmed_positive' WHEN level >= 1 AND certainty >= 0.4 AND score >= 35 THEN 'potential_catalyst' END AS board FROM s)"""


def _scored(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """Line items as extractions, scored. keep: the extractions are stored first, so that filters on a score don't work
    out its columns again for every place that names them."""
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values)).cast("int") + 1)
    s, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", pick(s, "cninfo", "sse", "irm", "ths", "bse").alias("provider"), (p % 5).cast("int").alias("level"), pick(n, 1.0, 0.9, 0.7, 0.45).alias("certainty"), pick(s, 100.0, 75.0, 50.0, 25.0).alias("unexpectedness"),
        pick(p, 100.0, 60.0, 30.0).alias("novelty"), (F.col("l_quantity") * 2.0).alias("timeliness"), (F.col("l_returnflag") == "R").alias("partial"), ((F.col("l_linestatus") == "O") & (p % 11 == 0)).alias("uncertain"), (s % 2 == 0).alias("has_history"),
    )
    c = F.col
    rows = cut(rows) if keep else rows
    rows = rows.withColumns({"confidence": S.source_confidence(c("provider")), "penalty": S.penalty(c("partial"), c("uncertain"), c("unexpectedness"), c("level"), c("novelty"), c("has_history"))})
    rows = rows.withColumn("score", S.score(c("confidence"), c("certainty"), c("level"), c("unexpectedness"), c("novelty"), c("timeliness"), c("penalty")))
    return rows.withColumn("board", S.board(c("score"), c("level"), c("certainty"), c("uncertain")))


@query(_EXTRACTIONS + " SELECT l_orderkey, l_linenumber, confidence, penalty, score, board FROM b")
def signal_score_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "confidence", "penalty", "score", "board")


@query(_EXTRACTIONS + """ SELECT l_orderkey, l_linenumber, CASE WHEN board IS NULL THEN coalesce(nullif(concat_ws('；', CASE WHEN level < 1 THEN '重大性不足1级' WHEN level < 2 THEN '重大性不足2级' END, CASE WHEN certainty < 0.4 THEN '确定性不足0.40' WHEN certainty < 0.7 THEN '确定性不足0.70' END,
 CASE WHEN score < 35 THEN '得分不足35' WHEN score < 60 THEN '得分不足60' END, CASE WHEN uncertain THEN '高不确定性反证' END), ''), '未达确定性利好/潜在催化门槛') END AS reason FROM b""")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", S.rejection(c("score"), c("level"), c("certainty"), c("uncertain")).alias("reason"))


@query(_EXTRACTIONS + " SELECT penalty, count(*) AS n FROM b GROUP BY penalty")
def penalty_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("penalty").agg(F.count("*").alias("n"))


@query(_EXTRACTIONS + """ SELECT l_orderkey, l_linenumber, board, CAST(row_number() OVER (PARTITION BY board ORDER BY score DESC, level DESC, certainty DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM b WHERE board IS NOT NULL QUALIFY rank <= 50""")
def signal_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first rows of each board are kept before the shuffle, so a task holds two short lists
    order = [F.desc("score"), F.desc("level"), F.desc("certainty"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    rank = F.row_number().over(W.partitionBy("board").orderBy(*order))
    return _scored(spark, sf_dir, keep=True).where("board is not null").withColumn("rank", rank).where("rank <= 50").select("l_orderkey", "l_linenumber", "board", "rank")


@query(_EXTRACTIONS + """ SELECT l_orderkey, l_linenumber, (certainty < 0.7 OR score < 35 OR level < 1 OR certainty < 0.4) AS ambiguous, CAST((level >= 1)::INT + (level >= 2)::INT + (certainty >= 0.4)::INT + (certainty >= 0.7)::INT + (NOT uncertain)::INT + (score >= 35)::INT + (score >= 60)::INT AS INTEGER) AS passed FROM b""")
def ambiguity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = _scored(spark, sf_dir).withColumn("trace", S.gates(c("score"), c("level"), c("certainty"), c("uncertain")))
    return rows.select("l_orderkey", "l_linenumber", S.ambiguous(c("certainty"), c("trace")).alias("ambiguous"), F.size(F.filter("trace", lambda g: g["passed"])).alias("passed"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.01 THEN 0 WHEN l_discount < 0.05 THEN 1 WHEN l_discount < 0.15 THEN 2 WHEN l_discount < 0.3 THEN 3 ELSE 4 END AS level, CASE WHEN l_discount / 10 < 0.001 THEN 0 WHEN l_discount / 10 < 0.005 THEN 1 WHEN l_discount / 10 < 0.01 THEN 2 WHEN l_discount / 10 < 0.03 THEN 3 ELSE 4 END AS buyback_level FROM lineitem""")
def materiality_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.materiality_level(F.col("l_discount")).alias("level"), S.materiality_level(F.col("l_discount") / 10, buyback=True).alias("buyback_level"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'cold_start' WHEN o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN 'partial' WHEN o_orderdate <= TIMESTAMP '1998-01-01' THEN 'ok' ELSE 'provisional' END AS state,
 CASE WHEN o_orderkey % 11 = 0 THEN 'unavailable' WHEN o_orderkey % 13 = 0 THEN 'stale' WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'complete' END AS status, hour(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))) >= 18 AND o_orderkey % 2 = 1 AS publish FROM orders""")
def coverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    error, success = F.when(k % 7 == 0, "timeout"), F.when(k % 5 != 0, F.col("o_orderdate"))
    state = S.coverage_state(error, success, F.col("o_orderdate"), F.lit("1998-01-01").cast("timestamp_ntz"), k % 3 == 0)
    status = S.source_status(k % 11 != 0, k % 13 == 0, k % 2 == 1, error)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), status.alias("status"), S.may_publish(k % 24, F.lit(True), k % 2 == 1).alias("publish"))
