"""Shared folders, cut lineage and word offsets for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: Word separators by byte. UTF-8 continuation bytes are all above 0x7F, so these classes hold on bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text worked on at a time: arrays of a word's width then stay within a core's cache.
SLICE_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame) -> DataFrame:
    """df written to and read from a Parquet table in the shared folder: smaller than a checkpoint for wide tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes of their texts (null: empty) and where each text starts, about limit bytes or one text each."""
    texts = batch.column(batch.schema.get_field_index(text_col))
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.string())
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the number of the first word of each text (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def placed(values: np.ndarray, at: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of each value at its place. Sums of these tell apart the same values in another order."""
    return mix(values ^ mix((at.astype(np.uint64) + np.uint64(1)) * _STEP + np.uint64(salt)))


def totals(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 and so on values, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def places(count: np.ndarray) -> np.ndarray:
    """0, 1 and so on for each of several groups of so many members."""
    begin = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(begin, count)


def word_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from its pieces of 8 bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    count = (size + 7) >> 3
    padded = np.concatenate([lowered, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(lowered) + 1, "<u8", padded, strides=(1,))
    piece = places(count)
    left = np.repeat(size, count) - 8 * piece
    held = eights[np.repeat(starts, count) + 8 * piece]
    short = left < 8
    held[short] &= (np.uint64(1) << (np.uint64(8) * left[short].astype(np.uint64))) - np.uint64(1)
    return mix(np.add.reduceat(placed(held, piece), np.cumsum(count) - count) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text (shorter texts: the whole run), and where each text's begin."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    start = np.repeat(first[:-1], count) + places(count)
    size = np.repeat(np.minimum(n, k), count)
    out = mix(size.astype(np.uint64) * _STEP)
    for i in range(k):
        more = np.flatnonzero(size > i) if size.min() <= i else slice(None)
        out[more] = mix((out[more] + words[start[more] + i]) * _STEP)
    return out, begin
