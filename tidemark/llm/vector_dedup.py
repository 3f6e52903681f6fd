"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are rotated by random orthogonal matrices; the signs are the binary code. Bits of the codes of several
rotations are the keys of hash tables, as many as lift the chance that a pair at the threshold meets in none below
MISS. Only codes are dealt to the tables at first: the share of bits in which two codes agree estimates their angle,
and vectors none of whose estimates comes within the bound of the threshold are done. The vectors of the others are
dealt to their tables and estimated again: <code, other> / <code, own> is an unbiased estimate of the inner product,
and the stored factor <code, own> bounds its error. Only pairs whose upper bound reaches the threshold are computed
exactly, in double precision.

A pair counts in the first table in which it meets. Buckets are cut into blocks by hash, and each task compares two
blocks, so no bucket is collected whole and no pair is written out: a block pair gives each vector's number of links
and enough edges to connect what is linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components

THRESHOLD = 0.9
#: Chance that a pair just at the threshold meets in no table.
MISS = 0.002
#: Vectors to a block; vectors to a bucket that the number of bits aims at.
BLOCK, BUCKET = 256, 64
#: Standard errors in the bound of an estimate; bits to a code, whatever the number of tables.
BOUND = 5.0
CODE_BITS = 256
MOST_BITS = 48


def plan(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits to a key and number of tables for n vectors."""
    bits = min(MOST_BITS, max(6, math.ceil(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 6))
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet))) if meet < 1 else 1


def rotations(d: int, count: int, seed: int = 11) -> np.ndarray:
    """count random orthogonal matrices, one below the other."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out) if out else np.zeros((0, d))


def table_keys(x: np.ndarray, turn: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each unit vector in each table: bits of the codes in order."""
    sign = (x @ turn.T > 0)[:, : bits * tables].reshape(len(x), tables, bits)
    return (sign * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(x: np.ndarray, y: np.ndarray, turned_x: np.ndarray, turned_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked vectors: estimates first, then exact cosines for those whose bound reaches the threshold."""
    d = x.shape[1]
    code = np.where(turned_x > 0, 1.0, -1.0) / math.sqrt(d)
    own = (code * turned_x).sum(axis=1)
    estimate = (code @ turned_y.T) / own[:, None]
    error = BOUND * np.sqrt(np.maximum(0.0, 1 - own**2) / own**2 / max(d - 1, 1))
    i, j = np.nonzero(estimate + error[:, None] >= threshold - 1e-9)
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        s = slice(at, at + (1 << 14))
        keep[s] = (x[i[s]] * y[j[s]]).sum(axis=1) >= threshold
    return i[keep], j[keep]


def _compare(dim: int, bits: int, tables: int, threshold: float):
    """Links within and between blocks: rows of (a, links, null) and of (a, null, b)."""
    turn = _turns(dim, bits, tables)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                t, left, right = batch.column(0)[r].as_py(), batch.column(1)[r].values, batch.column(2)[r].values if batch.column(2)[r].is_valid else None
                sides = []
                for rows in (left, right):
                    if rows is None:
                        sides.append(sides[0])
                        continue
                    x = unit(np.asarray(rows.field("v").flatten(), dtype=np.float64).reshape(len(rows), dim))
                    sides.append((np.asarray(rows.field("vid")), np.asarray(rows.field("copies")), x, x @ turn[:dim].T, table_keys(x, turn, bits, t)))
                (a, na, x, tx, kx), (b, nb, y, ty, ky) = sides
                i, j = _links(x, y, tx, ty, threshold)
                if right is None:
                    i, j = i[i < j], j[i < j]
                first = ~(kx[i] == ky[j]).any(axis=1)  # true for all in the first table, which has no keys before it
                i, j = i[first], j[first]
                count: dict[int, int] = {}
                edges: dict[int, int] = {}
                root: dict[int, int] = {}

                def top(v: int) -> int:
                    while root.setdefault(v, v) != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    return v

                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    va, vb = int(a[p]), int(b[q])
                    count[va] = count.get(va, 0) + int(nb[q])
                    count[vb] = count.get(vb, 0) + int(na[p])
                    ra, rb = top(va), top(vb)
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                for v in root:
                    if top(v) != v:
                        edges[v] = top(v)
                ids = [*count, *edges]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([*count.values(), *[None] * len(edges)], pa.int64()), pa.array([*[None] * len(count), *edges.values()], pa.int64())], ["a", "links", "b"])

    return compare


def usable(vector: str) -> F.Column:
    """True for vectors that can link: neither null nor empty nor zero, all components there and finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def link_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row of rows.

    Two rows link if the cosine of their vectors, in double precision, is at least the threshold; equal vectors always
    do. n_links counts the other rows linked directly, component_id is the smallest id reachable, kept tells whether
    that is the row's own. Null and zero vectors, and those with null or non-finite components, link with nothing and
    are components of their own. Vectors of different lengths don't link. Pairs just at the threshold are missed with
    probability `miss`, closer ones less often; none below is linked. Equal vectors are compared once. Rows that share
    an id each count. Ids are integers; a null id is in no component and has null there. Empty tables give empty ones.
    """
    kind = "float" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).withColumn("ok", usable("v"))
    # adding 0 makes -0 and 0 the same vector
    vectors = cut(vectors.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda c: c + F.lit(0.0).cast(kind)))))
    distinct = cut(vectors.where("ok").groupBy("v").agg(F.min("id").alias("vid"), F.count("*").alias("copies")).where("vid is not null"))
    found = None
    for r in distinct.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect():  # one for each length of vector
        part = _pairs(distinct.where(F.size("v") == r.dim), r.dim, r.n, threshold, block, miss)
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = cut(found)
    links = found.where("links is not null").groupBy(F.col("a").alias("vid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "vid")
    known = distinct.join(links, "vid", "left").join(roots, "vid", "left").select("v", "vid", "copies", "links", F.coalesce("component", "vid").alias("component"))
    joined = vectors.join(known, "v", "left")
    own = F.coalesce(F.col("component"), F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("copies") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def _turns(dim: int, bits: int, tables: int) -> np.ndarray:
    return rotations(dim, math.ceil(max(bits * tables, CODE_BITS) / dim))


def _most_apart(length: int, threshold: float) -> float:
    """Bits in which the codes of a pair at the threshold differ at most, within the bound."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return length * p + BOUND * math.sqrt(length * p * (1 - p)) + 1


def _likely(threshold: float):
    """The vectors of two blocks whose code comes close enough to another's."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in range(batch.num_rows):
                left = batch.column(1)[r].values
                right = batch.column(2)[r].values if batch.column(2)[r].is_valid else left
                ids, codes = zip(*((np.asarray(s.field("vid")), np.frombuffer(b"".join(s.field("code").to_pylist()), np.uint8).reshape(len(s), -1)) for s in (left, right)), strict=True)
                apart = np.zeros((len(ids[0]), len(ids[1])), np.uint16)
                for a, b in zip(*(np.ascontiguousarray(c).view(np.uint64).T for c in codes), strict=True):
                    apart += np.bitwise_count(a[:, None] ^ b[None, :])
                near = apart <= _most_apart(codes[0].shape[1] * 8, threshold)
                if right is left:
                    np.fill_diagonal(near, False)
                out += [ids[0][near.any(axis=1)], ids[1][near.any(axis=0)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *out])), pa.int64())], ["vid"])

    return find


def _block_pairs(keys: DataFrame, entry: list[str], block: int, extra: DataFrame | None = None) -> DataFrame:
    """(t, left, right) of each pair of blocks of a bucket of (vid, t, key); right is null for a block by itself.

    A vector's block is its hash's, so blocks come out about even and none needs more rows than two blocks hold.
    extra has further columns of the entries by vid.
    """
    sizes = cut(keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    placed = keys.join(sizes, ["t", "key"]).withColumn("blk", F.pmod(F.xxhash64("vid", "t"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")})
    met = met.join(extra, "vid") if extra is not None else met
    own = F.struct(*entry)
    groups = met.groupBy("t", "key", "i", "j").agg(F.collect_list(F.when(F.col("blk") == F.col("i"), own)).alias("left"), F.collect_list(F.when(F.col("blk") != F.col("i"), own)).alias("right"))
    return groups.select(F.col("t").cast("int").alias("t"), "left", F.when(F.col("i") != F.col("j"), F.col("right")).alias("right"))


def _pairs(distinct: DataFrame, dim: int, n: int, threshold: float, block: int, miss: float) -> DataFrame:
    bits, tables = plan(n, threshold, miss)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = _turns(dim, bits, tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = unit(np.asarray(part.column(1).flatten(), dtype=np.float64).reshape(-1, dim))
                code = np.packbits(x @ turn[:CODE_BITS].T > 0, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(table_keys(x, turn, bits, tables)), pa.list_(pa.int64())), pa.array([c.tobytes() for c in code], pa.binary())], ["vid", "keys", "code"])

    coded = cut(distinct.select("vid", "v").mapInArrow(deal, "vid long, keys array<long>, code binary"))
    keys = coded.select("vid", "code", F.posexplode("keys").alias("t", "key"))
    likely = cut(_block_pairs(keys, ["vid", "code"], block).mapInArrow(_likely(threshold), "vid long").distinct())
    again = coded.join(likely, "vid").select("vid", F.posexplode("keys").alias("t", "key"))
    full = distinct.join(likely, "vid").select("vid", "copies", "v")
    return _block_pairs(again, ["vid", "copies", "v"], block, full).mapInArrow(_compare(dim, bits, tables, threshold), "a long, links long, b long")
