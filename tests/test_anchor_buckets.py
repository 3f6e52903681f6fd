"""Keys of a stream that share a bucket keep anchors of their own, over batches and beyond the watermark."""

import random
from datetime import UTC, datetime, timedelta

from tidemark import streaming


def test_anchors_of_a_bucket_are_those_of_its_keys(spark, tmp_path):
    rng, start, schema = random.Random(4), datetime(2026, 1, 1, tzinfo=UTC), "k string, n int, i int, at timestamp"
    rows = sorted(((rng.choice(["a", "b", None]), rng.randrange(8), i, start + timedelta(minutes=rng.randrange(60 * 24 * 40))) for i in range(900)), key=lambda r: r[3])
    for n in range(3):
        spark.createDataFrame([*rows[n * 300 : (n + 1) * 300], ("a", 1, 1000 + n, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    streaming.drain(streaming.anchored(stream, ["k", "n"], "at", "i", "3 days", buckets=2), str(tmp_path / "out"), str(tmp_path / "cp"))
    want, anchors = [], {}
    for k, n, i, at in sorted(rows, key=lambda r: (r[3], r[2])):
        if (k, n) not in anchors or at - anchors[k, n] > timedelta(days=1):
            anchors[k, n] = at
            want.append(i)
    assert sorted(r.i for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want)


def test_only_anchors_that_can_still_bar_a_row_are_kept():
    assert streaming._live({"a": 0, "b": 100}, 50, 51_000) == {"b": 100} and streaming._live({"a": 0}, 50, 50_000) == {"a": 0}
