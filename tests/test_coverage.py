"""Coverage of sources by batches, and tables that lose whole days."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.sources import commits, sinks
from tidemark.streaming import coverage

ROWS = "id int, source string, at timestamp"


def landed(spark, days, first=0, source="a"):
    return spark.createDataFrame([(first + i, source, datetime(2026, 1, d, 12)) for i, d in enumerate(days)], ROWS)


def test_spans_grow_and_old_rows_are_late(spark, tmp_path):
    root, land = str(tmp_path / "tables"), str(tmp_path / "landed")
    sink = coverage.covering(root, "source", "at", "3 days")
    seen = []
    for days in ([5, 6, 9], [10, 4, 8], [20]):
        landed(spark, days).write.mode("append").parquet(land)
        stream = coverage.observed(streaming.files(spark, land, landed(spark, [1]).schema), "at")
        ended = streaming.drain(stream, "", str(tmp_path / "checkpoint"), sink=sink)
        seen += [(r.rows, r.earliest[:10], r.latest[:10]) for r in coverage.progress(spark, ended).where("rows > 0").collect()]
    assert seen == [(3, "2026-01-05", "2026-01-09"), (3, "2026-01-04", "2026-01-10"), (1, "2026-01-20", "2026-01-20")]
    row = commits.newest(spark, root, "coverage", coverage.COVERAGE).first()
    assert (row.covered_start.day, row.covered_end.day, row.cutoff.day, row.rows, row.late) == (4, 20, 17, 7, 1)
    days = commits.rows(spark, root, "days", coverage.DAYS)
    missing = coverage.missing_days(commits.newest(spark, root, "coverage", coverage.COVERAGE), days, F.dayofweek("day") != 1)
    assert sorted(r.day.day for r in missing.collect()) == [7, 12, 13, 14, 15, 16, 17, 19]
    done = coverage.completeness(commits.newest(spark, root, "coverage", coverage.COVERAGE), missing).first()
    assert (done.missing, done.complete) == (8, False)


def test_a_batch_sent_again_is_counted_once(spark, tmp_path):
    root = str(tmp_path)
    sink = coverage.covering(root, "source", "at", "1 day")
    for number, days in ((0, [5]), (0, [5]), (1, [6, 7]), (1, [6, 7])):
        sink(landed(spark, days).unionByName(landed(spark, [1], source=None)), number)
    assert [(r.source, r.rows, r.late) for r in commits.newest(spark, root, "coverage", coverage.COVERAGE).collect()] == [("a", 3, 0)]
    assert commits.rows(spark, root, "rows", ROWS).count() == 5


def test_a_batch_that_fails_before_its_marker_leaves_no_copy(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    sink = coverage.covering(root, "source", "at", "1 day")

    def fails(*_):
        raise OSError("no marker")

    monkeypatch.setattr(commits, "seal", fails)
    try:
        sink(landed(spark, [5]), 0)
    except OSError:
        pass
    monkeypatch.undo()
    assert commits.newest(spark, root, "coverage", coverage.COVERAGE).count() == 0
    sink(landed(spark, [5]), 0)
    assert commits.rows(spark, root, "rows", ROWS).count() == 1


def test_dropped_days_are_not_read(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = landed(spark, [1, 2, 2, 3, 9]).unionByName(spark.createDataFrame([(9, "a", None)], ROWS))
    sinks.write_days(rows, F.col("at"), path)
    assert sinks.days(spark, path) == [date(2026, 1, d) for d in (1, 2, 3, 9)]
    read = sinks.read_days(spark, path, date(2026, 1, 3))
    assert sorted(r.at.day for r in read.collect()) == [3, 9] and "PartitionFilters: [isnotnull(day" in read._jdf.queryExecution().executedPlan().toString()
    assert sinks.drop_days(spark, path, date(2026, 1, 3)) == [date(2026, 1, 1), date(2026, 1, 2)]
    assert sorted(r.at.day for r in spark.read.parquet(path).where("at is not null").collect()) == [3, 9] and spark.read.parquet(path).where("at is null").count() == 1
    assert sinks.drop_days(spark, str(tmp_path / "none"), date(2026, 1, 1)) == []


def test_publishing_nothing_keeps_all(spark, tmp_path):
    root = str(tmp_path)
    sinks.publish({"a": None}, root, 1)
    assert sinks.current(spark, root) == {}
    sinks.publish({"a": spark.range(2)}, root, 1)
    sinks.publish({"a": None, "b": None}, root, 2)
    assert sinks.current(spark, root) == {"a": 1}
