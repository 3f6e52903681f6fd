"""Date and time columns: years left out, relative times, trading-day arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def latest_year(month: Column, day: Column, hour: Column, minute: Column, now: Column) -> Column:
    """The latest of this and last year's date that is at most a day ahead of now; null if there is none."""
    def at(year: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d %02d:%02d:00", year.cast("int"), month.cast("int"), day.cast("int"), hour.cast("int"), minute.cast("int"))
        return text.try_cast("timestamp_ntz")

    years = [at(F.year(now)), at(F.year(now) - 1)]
    limit = now.cast("timestamp_ntz") + F.expr("interval 1 day")
    return F.greatest(*(F.when(y <= limit, y) for y in years))


def relative_time(text: Column, now: Column) -> Column:
    """刚刚, n 分钟/小时/天/周前, 昨天 HH:MM, or an absolute time."""
    n = F.regexp_extract(text, r"(\d+)\s*(分钟|小时|天|周)前", 1).try_cast("int")
    unit = F.regexp_extract(text, r"(\d+)\s*(分钟|小时|天|周)前", 2)
    at = now.cast("timestamp_ntz")
    seconds = n * F.when(unit == "分钟", 60).when(unit == "小时", 3600).when(unit == "天", 86400).when(unit == "周", 604800)
    clock = F.regexp_extract(text, r"昨天\s*(\d{1,2}:\d{2})", 1)
    return (
        F.when(F.contains(text, F.lit("刚刚")), at)
        .when(n.isNotNull(), at - F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))
        .when(clock != "", F.concat_ws(" ", F.date_format(F.date_sub(at.cast("date"), 1), "yyyy-MM-dd"), F.lpad(clock, 5, "0")).try_cast("timestamp_ntz"))
        .otherwise(F.regexp_replace(F.trim(text), r"[年月/]", "-").try_cast("timestamp_ntz"))
    )


def from_epoch_ms(ms: Column) -> Column:
    """Wall time in Shanghai of epoch milliseconds."""
    return F.to_timestamp_ntz(F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms.cast("long")), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss.SSS"))


def iso_week(day: Column) -> Column:
    """struct<year, week> of the ISO calendar."""
    return F.struct(F.extract(F.lit("YEAROFWEEK"), day).alias("year"), F.weekofyear(day).alias("week"))


def timeliness(at: Column, start: Column, end: Column) -> Column:
    """100 at the window's end and after, falling in line to 0 at its start and before."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    share = (seconds(at) - seconds(start)) / F.greatest(seconds(end) - seconds(start), F.lit(1.0))
    return 100.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))
