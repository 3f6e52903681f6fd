"""Structured Streaming forms: windows with watermarks, idempotent redelivery, keyed anchors, upserts per batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of landed Parquet files; files_per_batch is the page budget of one trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, at: str, key: str, width: str, delay: str, value: str) -> DataFrame:
    """Rows and sums per window and key. In append and update mode rows later than the delay are dropped, and a window's
    state with them; complete mode keeps all windows, and drops none."""
    counts = stream.withWatermark(at, delay).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("window.start").alias("start"), key, "n", "total")


def once(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Each key once within the watermark: redelivered rows go."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def anchored(stream: DataFrame, key: list[str], at: str, row_id: str, delay: str, seconds: int = 86_400, buckets: int = 1024) -> DataFrame:
    """The streaming form of the anchor fold: state is one time for each key. Rows of a batch are taken in time order.

    A key's state is of no more use once the watermark is past its anchor's window: it goes when its bucket is next
    called, the bucket's when all its keys are past, so state is bounded by the keys of late; rows behind the watermark
    are too late for it and go as well, and so do rows without a time. Keys share buckets by hash, as a call of a group takes far longer than a row;
    buckets is also the most tasks that can share the work.
    """

    def keep(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mark, kept = state.getCurrentWatermarkMs(), []
        anchors = _live(json.loads(state.get[0]) if state.exists else {}, seconds, mark)
        rows = sorted(r for f in frames for r in zip(f["__t"].tolist(), f[row_id].tolist(), f["__key"].tolist(), strict=True))
        for t, i, k in rows:
            if t * 1000 >= mark and (k not in anchors or t - anchors[k] > seconds):
                anchors[k] = int(t)
                kept.append(i)
        if anchors:
            state.update((json.dumps(anchors),))
            state.setTimeoutTimestamp(max((max(anchors.values()) + seconds + 1) * 1000, mark + 1))
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame({row_id: kept})

    timed = stream.withWatermark(at, delay).withColumn("__t", F.unix_seconds(F.col(at).cast("timestamp")))
    placed = timed.where("__t is not null").select(at, "__t", row_id, F.to_json(F.struct(*key)).alias("__key"), F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("__bucket"))
    kind = stream.schema[row_id].dataType.simpleString()
    return placed.groupBy("__bucket").applyInPandasWithState(keep, f"{row_id} {kind}", "anchors string", "append", GroupStateTimeout.EventTimeTimeout)


def _live(anchors: dict[str, int], seconds: int, mark: int) -> dict[str, int]:
    """Anchors whose window a row that isn't too late can still be in."""
    return {k: t for k, t in anchors.items() if (t + seconds) * 1000 >= mark}


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Runs a stream over all that has landed, into Parquet files or a function of each batch, and stops. The ended query
    has the progress of its batches."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", target)).start()
    query.awaitTermination()
    return query
