"""Transparent signal scores, penalties and gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Confidence by provider, weights, penalties and gates of the score.
CONFIDENCE = {"cninfo": 1.0, "sse": 0.9, "irm": 0.9, "ths": 0.6}
OTHER_CONFIDENCE = 0.6
WEIGHTS = {"materiality": 0.35, "unexpectedness": 0.25, "novelty": 0.20, "timeliness": 0.20}
STAGES = {"executed": 1.0, "signed": 0.9, "awarded": 0.7, "framework": 0.45, "rumor": 0.2}
MOST_PENALTY = 80.0


def source_confidence(provider: Column, table: dict[str, float] = CONFIDENCE, other: float = OTHER_CONFIDENCE) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[provider], F.lit(other))


def materiality(level: Column) -> Column:
    return F.when(level.between(0, 4), level * 25.0).otherwise(0.0)


def materiality_level(ratio: Column, buyback: bool = False) -> Column:
    """0 to 4 by a ratio's size; buybacks have their own scale; null for null."""
    steps = (0.001, 0.005, 0.01, 0.03) if buyback else (0.01, 0.05, 0.15, 0.30)
    return F.when(ratio.isNotNull(), sum((ratio >= s).cast("int") for s in steps))


def penalty(partial: Column, uncertain: Column, unexpectedness: Column, level: Column, novelty: Column, has_history: Column) -> Column:
    parts = ((partial, 15.0), (uncertain, 35.0), (unexpectedness == 25.0, 20.0), (level == 0, 20.0), ((novelty == 30.0) & has_history, 40.0))
    return F.least(sum(F.when(test, p).otherwise(0.0) for test, p in parts), F.lit(MOST_PENALTY))


def score(confidence: Column, certainty: Column, level: Column, unexpectedness: Column, novelty: Column, timeliness: Column, penalties: Column) -> Column:
    """The lower of source confidence and certainty times the weighted parts, less penalties."""
    w = WEIGHTS
    return F.least(confidence, certainty) * (w["materiality"] * materiality(level) + w["unexpectedness"] * unexpectedness + w["novelty"] * novelty + w["timeliness"] * timeliness) - penalties


def gates(points: Column, level: Column, certainty: Column, uncertain: Column) -> Column:
    """array<struct<gate, passed>> of the gates in order."""
    tests = (("materiality", level >= 1), ("confirmed_materiality", level >= 2), ("certainty", certainty >= 0.40), ("confirmed_certainty", certainty >= 0.70), ("certain", ~uncertain), ("score", points >= 35.0), ("confirmed_score", points >= 60.0))
    return F.array(*(F.struct(F.lit(n).alias("gate"), t.alias("passed")) for n, t in tests))


def board(points: Column, level: Column, certainty: Column, uncertain: Column) -> Column:
    """confirmed_positive, potential_catalyst or null."""
    confirmed = (level >= 2) & (certainty >= 0.70) & ~uncertain & (points >= 60.0)
    return F.when(confirmed, "confirmed_positive").when((level >= 1) & (certainty >= 0.40) & (points >= 35.0), "potential_catalyst")


def rejection(points: Column, level: Column, certainty: Column, uncertain: Column, separator: str = "；") -> Column:
    """Why a signal is on no board, in order; null if it is on one."""
    reasons = F.array(
        F.when(level < 1, "重大性不足1级").when(level < 2, "重大性不足2级"),
        F.when(certainty < 0.40, "确定性不足0.40").when(certainty < 0.70, "确定性不足0.70"),
        F.when(points < 35.0, "得分不足35").when(points < 60.0, "得分不足60"),
        F.when(uncertain, "高不确定性反证"),
    )
    said = F.filter(reasons, lambda r: r.isNotNull())
    text = F.when(F.size(said) > 0, F.array_join(said, separator)).otherwise(F.lit("未达确定性利好/潜在催化门槛"))
    return F.when(board(points, level, certainty, uncertain).isNull(), text)


def ambiguous(certainty: Column, trace: Column) -> Column:
    """True for low certainty or a failed gate of score, materiality or certainty."""
    return (certainty < 0.70) | F.exists(trace, lambda g: ~g["passed"] & g["gate"].isin("score", "materiality", "certainty"))


def coverage_state(error: Column, success: Column, covered: Column, target: Column, partial: Column) -> Column:
    """error, cold_start, partial, ok or provisional, in that order."""
    return F.when(error.isNotNull() & success.isNull(), "error").when(success.isNull(), "cold_start").when(partial | error.isNotNull(), "partial").when(covered <= target, "ok").otherwise("provisional")


def source_status(available: Column, stale: Column, complete: Column, error: Column) -> Column:
    return F.when(~available, "unavailable").when(stale, "stale").when(~complete & error.isNotNull(), "failed").when(~complete, "partial").otherwise("complete")


def may_publish(hour: Column, fresh: Column, complete: Column, least_hour: int = 18) -> Column:
    """True from six in the evening on, for fresh and complete data."""
    return (hour >= least_hour) & fresh & complete


def review(outcome: Column, certainty: Column) -> Column:
    """struct<verified, certainty>: agreement verifies; other outcomes only leave a trace."""
    return F.struct((outcome == "agree").alias("verified"), certainty.alias("certainty"))


def shown_metric(metrics: Column) -> Column:
    """The first of array<struct<name, value, unit>> as name, value and unit; a dash without one.

    A value is shown with six digits, without zeros at the end, and with an exponent if it is very small or large.
    """
    first = F.try_element_at(metrics, F.lit(1))
    value = first["value"]
    plain = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    # rounding to six digits can add a digit before the point
    digits = F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(F.format_string("%.5e", value).cast("double")))))
    mantissa = plain(F.regexp_extract(F.format_string("%.5e", value), r"^([^e]*)e", 1))
    exponent = F.format_string("e%s%02d", F.when(digits < 0, "-").otherwise("+"), F.abs(digits).cast("int"))
    fixed = F.coalesce(*(F.when(digits == d, plain(F.format_string(f"%.{5 - d}f", value))) for d in range(-4, 6)))
    text = F.when(value.isNull(), "").when(value == 0, "0").otherwise(F.coalesce(fixed, F.concat(mantissa, exponent)))
    parts = F.filter(F.array(F.coalesce(first["name"], F.lit("")), text, F.coalesce(first["unit"], F.lit(""))), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("—")


def shown_evidence(items: Column, most: int = 240) -> Column:
    """The summaries of array<struct<kind, summary>>, kinds where there is none, joined and cut at `most` characters."""
    labels = F.transform(items, lambda x: F.coalesce(F.nullif(x["summary"], F.lit("")), x["kind"], F.lit("")))
    return F.coalesce(F.substring(F.array_join(labels, "；"), 1, most), F.lit(""))
