"""SimHash fingerprints linked by covering locality-sensitive hashing.

Bit i of a fingerprint has a label in {1..15}, read as a vector of 4 bits. Table v (1..15) keeps the bits whose label
has an odd inner product with v. Three differing bits have labels in a space of at most 3 dimensions, so some v is
orthogonal to all of them: that table masks all differing bits out, and every pair within radius 3 collides there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_or_empty
from .components import components

RADIUS = 3
#: Members up to which a bucket is compared in one go; larger ones go through balls of keys, which is exact as well.
BUCKET = 256
MASKS = [sum(1 << i for i in range(64) if ((i % 15 + 1) & v).bit_count() & 1) for v in range(1, 16)]


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the XXH64 of a text's word shingles; without words 0."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    spans = map(slice, starts[:k].tolist(), ends[len(words) - k :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)), np.uint64, k)
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > k, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long. Null texts count as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(x.as_py()) for x in part.column(1)], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(make, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Enough pairs within the radius to connect whatever such pairs connect."""
    left, out = np.arange(len(fps)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(fps[front, None] ^ fps[None, left]) <= radius
            hit = near.any(axis=0)
            out += zip(fps[front[near.argmax(axis=0)[hit]]].view(np.int64).tolist(), fps[left[hit]].view(np.int64).tolist(), strict=True)
            front, left = left[hit], left[~hit]
    return out


def _pairs_in_buckets(radius: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for members in batch.column(0) for p in spanning(np.array(members.as_py(), dtype=np.int64).view(np.uint64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return find


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All keys at up to two flipped bits from each fingerprint."""
    one = [1 << i for i in range(64)]
    flips = np.array([0, *one, *(x | y for i, x in enumerate(one) for y in one[:i])], np.uint64)
    far = np.bitwise_count(flips).astype(np.int32)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 64):
            part = fps[at : at + 64]
            keys = (part[:, None] ^ flips[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(far, len(part))), pa.array(np.repeat(part, len(flips)).view(np.int64))], ["z", "far", "fp"])


def near_pairs(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of fingerprints within 3 bits, enough of them to connect all that such pairs connect.

    distinct has one row for each fingerprint in column fp. A table's bucket of two is compared as it stands; one of
    up to `bucket` members is compared in one task; the members of larger ones get every key within two flipped bits,
    and all under one key are tied to one that is at most one flip from it (1 + 2 = 3), without listing their pairs.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in MASKS]
    tables = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(m).cast("long").alias("mask")) for v, m in enumerate(signed)))
    dealt = distinct.select("fp", F.explode(tables).alias("t")).select(F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")
    sizes = dealt.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = cut(sizes)
    two = sizes.where("n = 2").select("a", "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()
    more = cut(dealt.join(sizes.where("n > 2").select("v", "key", "n"), ["v", "key"]))
    some = more.where(F.col("n") <= bucket).groupBy("v", "key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(_pairs_in_buckets(RADIUS), "a long, b long")
    keys = more.where(F.col("n") > bucket).select("fp").distinct().mapInArrow(_ball, "z long, far int, fp long")
    centres = keys.groupBy("z").agg(F.min(F.struct("far", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1 and c.far <= 1").select("z", F.col("c.fp").alias("a"))
    many = keys.join(centres, "z").where("fp <> a").select("a", F.col("fp").alias("b"))
    return two.union(some).union(many)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id_col, fp, fingerprint, component_id): every row with its 64-bit fingerprint and the smallest id reachable by links.

    Fingerprints link at 3 or fewer differing bits; equal ones always link. Null and wordless texts have fingerprint 0
    and link like any other. Null ids stay as rows but never name a component unless all ids of it are null. Repeated
    rows are each returned. An empty table gives an empty table. Other columns are not read, so their names can't clash.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_pairs(distinct, bucket)).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("least"))
    of_linked = roots.join(least, "component").select("fp", F.col("least").alias("lower"))
    # a table of its own, so that the last join has two plain shuffled sides and Spark can split a hot fingerprint
    ids = cut(distinct.join(of_linked, "fp", "left").select("fp", F.coalesce("lower", "least").alias("component_id")))
    return rows.join(ids, "fp", "left").select(F.col("id").alias(id_col), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
