"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by their number n of distinct shingles, into powers of two. A text that holds a share t of an
item misses n - ceil(t n) of its shingles at most. An item's sketch is its n - ceil(t n) + 1 smallest shingle hashes,
so at least one sketch hash is in any such text: the search misses none. Hashes of shingles that more items hold count
as larger, so a shingle of all items is in the sketch of none that has enough others. Texts are probed with their own
hashes; long texts need no signature of their own, whose agreement with a short item would be far below what banding
can find.

Few items go to every executor, and texts aren't shuffled. Many are searched by a join: a bit map of fixed size, in
which every sketch hash of a size class sets a bit, goes to every executor, and a text sends only hashes whose bit is
set in a class that it is long enough for. Each text then meets its candidates once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, mix, shingle_hashes, slices, stored, text_or_empty, word_bounds, word_hashes

SHINGLE, CONTAINMENT = 5, 0.8
#: Sketches and item texts go to every executor up to these sizes; beyond them the search is a shuffled join.
BROADCAST_HASHES, BROADCAST_BYTES = 500_000, 16 << 20
#: Bits of the map of sketch hashes, as a power of two: eight megabytes.
MAP_BITS = 26
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def shingles(text: str, k: int = SHINGLE) -> set[tuple[str, ...]]:
    """The distinct runs of k words of a text, its whole run of words if shorter, none without words."""
    words = WORD.findall(text.translate(_UPPER))
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} - {()}


def needed(n: int, share: float) -> int:
    return max(1, math.ceil(share * n - 1e-9))


def _hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_bounds(data, offsets, NOT_ALNUM)
    return shingle_hashes(word_hashes(LOWER[data], starts, ends), first, k)


def sketches(items: DataFrame, id_col: str, text_col: str, k: int, share: float) -> DataFrame:
    """(item_id, size_class, hash) of the sketch of every item; items without words have none."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                hashes, begin = _hashes(data, offsets, k)
                own = [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(part))]
                at = np.repeat(np.arange(len(part)), [len(x) for x in own])
                size = np.array([len(x) for x in own], np.int32)[at] if len(at) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(size), pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], ["item_id", "n", "hash"])

    rows = items.select(F.col(id_col).alias("item_id"), text_or_empty(text_col).alias("text"))
    whole = rows.mapInArrow(make, T.StructType([rows.schema["item_id"], T.StructField("n", T.IntegerType()), T.StructField("hash", T.LongType())]))
    held = whole.groupBy("hash").agg(F.count("*").alias("held"))
    ordered = whole.join(held, "hash").groupBy("item_id", "n").agg(F.array_sort(F.collect_list(F.struct("held", "hash"))).alias("h"))
    few = F.col("n") - F.greatest(F.ceil(F.col("n") * share - 1e-9).cast("int"), F.lit(1)) + 1
    return ordered.select("item_id", F.floor(F.log2("n") + 1e-9).cast("int").alias("size_class"), F.explode(F.transform(F.slice("h", F.lit(1), few), lambda x: x["hash"])).alias("hash"))


class Search:
    """Items on one executor: sketch hashes in order with their items, and the items' texts to verify."""

    def __init__(self, sketch: list[tuple], texts: list[tuple], k: int, share: float) -> None:
        self.k, self.share, self.ids = k, share, [x[0] for x in texts]
        self.texts, self.held = [x[1] for x in texts], {}
        number = {x: i for i, x in enumerate(self.ids)}
        parts = {}
        for item, size, h in sketch:
            parts.setdefault(size, []).append((h % (1 << 64), number[item]))
        self.parts = []
        for rows in parts.values():
            rows.sort()
            self.parts.append((np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)))

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """(text, item) numbers that share a sketch hash."""
        hashes, begin = _hashes(data, offsets, self.k)
        found = set()
        for sketch, item in self.parts:
            small = np.flatnonzero(hashes <= sketch[-1])
            left = np.searchsorted(sketch, hashes[small], "left")
            hit = sketch[left] == hashes[small]
            at, left = small[hit], left[hit]
            right = np.searchsorted(sketch, hashes[at], "right")
            text = np.searchsorted(begin, at, "right") - 1
            for t, a, b in set(zip(text.tolist(), left.tolist(), right.tolist(), strict=True)):
                found.update((t, i) for i in item[a:b].tolist())
        return sorted(found)

    def item(self, i: int) -> set[tuple[str, ...]]:
        if i not in self.held:
            self.held[i] = shingles(self.texts[i], self.k)
        return self.held[i]

    def verified(self, part: pa.RecordBatch, text_at: int, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, shared) of the candidates that hold."""
        last, own = -1, set()
        for t, i in self.candidates(data, offsets):
            if t != last:
                last, own = t, shingles(part.column(text_at)[t].as_py() or "", self.k)
            n, shared = len(self.item(i)), len(self.item(i) & own)
            if shared >= needed(n, self.share):
                yield t, i, n, shared


def _bounded(items: DataFrame, sketch: DataFrame, id_col: str, text_col: str, k: int, share: float, most_hashes: int, most_bytes: int) -> Search | None:
    """The search structure if the items are within the bounds, else None."""
    total = items.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if total.b + 64 * total.n > most_bytes or sketch.count() > most_hashes:
        return None
    texts = items.where(F.col(id_col).isNotNull()).select(F.col(id_col), text_or_empty(text_col)).distinct().collect()
    return Search([tuple(r) for r in sketch.collect()], [tuple(r) for r in texts], k, share)


def _unique(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id that isn't null; of several texts the first by code point counts."""
    return items.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.col(text_col).cast("string")).alias(text_col))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE, share: float = CONTAINMENT, most_hashes: int = BROADCAST_HASHES, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id_col, item_id, n_item, n_shared, containment) of every document and item of which it holds at least `share`.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; shingles are k words, or all words of
    a shorter text. Null texts count as empty; texts and items without words match nothing. Items with a null id are
    left out; of several texts under one item id the first by code point counts. Several rows of one document id give
    one row for each item, with the most shared shingles. Empty tables give an empty table. Other columns aren't read.
    """
    items = _unique(items, item_col, item_text)
    sketch = stored(sketches(items, item_col, item_text, k, share))
    search = _bounded(items, sketch, item_col, item_text, k, share, most_hashes, most_bytes)
    return _found(docs, items, sketch, search, id_col, text_col, item_col, item_text, k, share)


def _found(docs: DataFrame, items: DataFrame, sketch: DataFrame, search: Search | None, id_col: str, text_col: str, item_col: str, item_text: str, k: int, share: float) -> DataFrame:
    """The rows of contaminated(), by the search structure or, without one, by the join."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    long = T.LongType()
    schema = T.StructType([rows.schema["id"], T.StructField("item_id", sketch.schema["item_id"].dataType), T.StructField("n_item", long), T.StructField("n_shared", long)])
    if search is not None:
        held = docs.sparkSession.sparkContext.broadcast(search)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = held.value
            for batch in batches:
                for part, data, offsets in slices(batch, "text"):
                    hits = list(s.verified(part, 1, data, offsets))
                    if hits:
                        t, i, n, shared = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t)), pa.array([s.ids[x] for x in i]), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], ["id", "item_id", "n_item", "n_shared"])

        found = rows.mapInArrow(find, schema)
    else:
        found = _joined(rows, items, sketch, item_col, item_text, k, share, schema)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("n_shared", "n_item")).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", "m.n_item", "m.n_shared", (F.col("m.n_shared") / F.col("m.n_item")).alias("containment"))


def _bits(hashes: np.ndarray, size_class: np.ndarray | int) -> np.ndarray:
    """Where the hashes of a size class stand in the map."""
    return mix(hashes + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(size_class).astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - MAP_BITS)


def _map(sketch: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The map of a sketch's hashes, as 64-bit words, and its size classes."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(0)))
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = sketch.select("size_class", "hash").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # a word of the map each
    out = np.zeros(1 << MAP_BITS - 6, np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.view(np.uint64), [r.size_class for r in sketch.select("size_class").distinct().collect()]  # one for each power of two


def _joined(rows: DataFrame, items: DataFrame, sketch: DataFrame, item_col: str, item_text: str, k: int, share: float, schema: T.StructType) -> DataFrame:
    """The same search for any number of items: hashes of texts that the map lets through meet the sketches in a join."""
    held = rows.sparkSession.sparkContext.broadcast(_map(sketch))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, classes = held.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                hashes, begin = _hashes(data, offsets, k)
                text = np.repeat(np.arange(len(part)), np.diff(begin))
                most = np.diff(begin)[text] if len(text) else np.zeros(0, np.int64)
                for c in classes:
                    fits = np.flatnonzero(most >= needed(1 << c, share))  # the text can hold an item of the class
                    at = _bits(hashes[fits], c)
                    some = fits[(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text[some])), pa.array(np.full(len(some), c, np.int32)), pa.array(hashes[some].view(np.int64))], ["rk", "size_class", "hash"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ids, n_item, n_shared = [], [], [], []
            for i in range(batch.num_rows):
                whole = shingles(batch.column(1)[i].as_py(), k)
                for candidate in batch.column(2)[i].as_py():
                    own = shingles(candidate["item_text"], k)
                    shared = len(own & whole)
                    if shared >= needed(len(own), share):
                        at, ids, n_item, n_shared = [*at, i], [*ids, candidate["item_id"]], [*n_item, len(own)], [*n_shared, shared]
            item = batch.schema.field(2).type.value_type.field("item_id").type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ids, item), pa.array(n_item, pa.int64()), pa.array(n_shared, pa.int64())], schema.names)

    keyed = rows.select(F.xxhash64("id", "text").alias("rk"), "id", "text")
    probes = keyed.select("rk", "text").mapInArrow(probe, "rk long, size_class int, hash long").distinct()
    pairs = probes.join(sketch, ["size_class", "hash"]).select("rk", "item_id").distinct()
    texts = items.select(F.col(item_col).alias("item_id"), text_or_empty(item_text).alias("item_text"))
    # a text's candidates each share a shingle with it, so there are no more than its own shingles lead to
    candidates = pairs.join(texts, "item_id").groupBy("rk").agg(F.collect_list(F.struct("item_id", "item_text")).alias("candidates"))
    return keyed.join(candidates, "rk").select("id", "text", "candidates").mapInArrow(verify, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = SHINGLE, share: float = CONTAINMENT, most_hashes: int = BROADCAST_HASHES, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, with their columns as they are, that hold no item; within the bounds without a shuffle."""
    unique = _unique(items, item_col, item_text)
    sketch = stored(sketches(unique, item_col, item_text, k, share))
    search = _bounded(unique, sketch, item_col, item_text, k, share, most_hashes, most_bytes)
    if search is None:
        bad = _found(docs, unique, sketch, None, id_col, text_col, item_col, item_text, k, share).select(F.col(id_col).alias("bad_id")).distinct()
        return docs.join(bad, F.col(id_col).eqNullSafe(F.col("bad_id")), "left_anti")
    held, at, names = docs.sparkSession.sparkContext.broadcast(search), docs.schema.names.index(text_col), docs.schema.names

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(at)):
                good = np.ones(len(part), bool)
                good[[t for t, *_ in held.value.verified(part, at, data, offsets)]] = False
                yield part.filter(pa.array(good)).rename_columns(names)

    return docs.mapInArrow(keep, docs.schema)
