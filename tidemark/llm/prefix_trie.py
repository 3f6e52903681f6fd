"""Prefix trie of conversations by adaptive radix trees.

A node is a distinct sequence of first turns, from the empty one (the root) on; its members are the conversations that
start with it. A turn is its role and text, known by a fixed-width big-endian id of TURN bytes (the MD5 digest of both,
so unlike turns have unlike ids but for chance of some 2**-64). The key of a conversation is its ids one after another.

Conversations of the same turns are counted first, and one of them stands for all. Keys are cut into bands of BAND
turns; a band is known by a digest of all bands before it, so that bands of long conversations are worked on side by
side. Keys are put in ranges and read in order; each task builds radix trees of BLOCK keys, with nodes that grow from
4 to 16, 48 and 256 places and hold the bytes that all keys below share. Only depths that are whole turns give nodes.
Keys are in order, so a node that is no prefix of the first or last key of its block, nor of a key that goes on in
another band, is done there. The others are few: they are added up over blocks and bands, and sums over subtrees
follow from doubled steps towards the root, in as many rounds as the depth has binary digits.

Rows with a null id are left out. Null roles and texts are empty. Turns of a number stand in the order of role and id;
equal rows are turns of their own. Other columns are left alone. An empty table gives an empty table.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import cut, stored

TURN, BAND, BLOCK, IDS = 16, 64, 16_384, 4096
EMPTY = sha256(b"").hexdigest()
LAYOUTS = (4, 16, 48, 256)
BASE, HEADS = 100, 6

_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = pa.schema([("done", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in _LONGS), ("chars", pa.int64()), ("ends_sha256", pa.string())])


class Inner:
    """An inner node: bytes that all keys below share, then one child for each next byte.

    Up to 16 children stand beside their bytes in order, up to 48 behind an index of all bytes, beyond that at their
    byte.
    """

    __slots__ = ("prefix", "layout", "bytes", "children", "own", "some")

    def __init__(self, prefix: bytes, some: int):
        self.prefix, self.some, self.own, self.layout = prefix, some, None, 0
        self.bytes, self.children = bytearray(), []

    def get(self, byte: int):
        if self.layout < 2:
            at = bisect_left(self.bytes, byte)
            return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None
        if self.layout == 2:
            return self.children[self.bytes[byte] - 1] if self.bytes[byte] else None
        return self.children[byte]

    def put(self, byte: int, child) -> None:
        """Adds or replaces a child; a full node grows to the next layout."""
        if self.layout < 2:
            at = bisect_left(self.bytes, byte)
            if at < len(self.bytes) and self.bytes[at] == byte:
                self.children[at] = child
            elif len(self.bytes) < LAYOUTS[self.layout]:
                self.bytes.insert(at, byte)
                self.children.insert(at, child)
            else:
                self._grow()
                self.put(byte, child)
        elif self.layout == 2:
            if self.bytes[byte]:
                self.children[self.bytes[byte] - 1] = child
            elif len(self.children) < LAYOUTS[2]:
                self.children.append(child)
                self.bytes[byte] = len(self.children)
            else:
                self._grow()
                self.put(byte, child)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        pairs = list(self.items())
        self.layout += 1
        if self.layout == 2:
            self.bytes = bytearray(256)
            for n, (byte, _) in enumerate(pairs):
                self.bytes[byte] = n + 1
            self.children = [c for _, c in pairs]
        elif self.layout == 3:
            self.bytes, self.children = bytearray(), [None] * 256
            for byte, child in pairs:
                self.children[byte] = child

    def items(self) -> Iterator[tuple[int, object]]:
        if self.layout < 2:
            yield from zip(self.bytes, self.children, strict=True)
        else:
            for byte in range(256):
                child = self.get(byte)
                if child is not None:
                    yield byte, child


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Bytes that two keys share from a place on."""
    most = min(len(a), len(b))
    step = at
    while step + TURN <= most and a[step : step + TURN] == b[step : step + TURN]:
        step += TURN
    while step < most and a[step] == b[step]:
        step += 1
    return step - at


class RadixTree:
    """An adaptive radix tree over distinct keys; leaves are numbers of keys."""

    def __init__(self, keys: list[bytes]):
        self.keys, self.root = keys, None
        for i in range(len(keys)):
            self._insert(i)

    def _fork(self, some: int, other: int, at: int) -> Inner:
        """The node where two keys part, or where one of them ends."""
        size = _shared(self.keys[some], self.keys[other], at)
        return Inner(self.keys[other][at : at + size], some)

    def _hang(self, node: Inner, i: int, at: int) -> None:
        key = self.keys[i]
        if at == len(key):
            node.own = i
        else:
            node.put(key[at], i)

    def _insert(self, i: int) -> None:
        key, node, at, above, byte = self.keys[i], self.root, 0, None, 0
        while node is not None:
            if isinstance(node, int):
                fork = self._fork(node, i, at)
                self._hang(fork, node, at + len(fork.prefix))
                self._hang(fork, i, at + len(fork.prefix))
                break
            same = _shared(node.prefix, key[at : at + len(node.prefix)], 0)
            if same < len(node.prefix):
                fork = Inner(node.prefix[:same], node.some)
                fork.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                self._hang(fork, i, at + same)
                break
            at += same
            if at == len(key):
                node.own = i
                return
            above, byte = node, key[at]
            node, at = node.get(byte), at + 1
            if node is None:
                above.put(byte, i)
                return
        else:
            fork = i
        if above is None:
            self.root = fork
        else:
            above.put(byte, fork)

    def nodes(self) -> Iterator[tuple[int, int, int | None, int]]:
        """(parent, depth, own key, some key below) of every depth that is whole turns, parents first; parent -1: none."""
        count, todo = 0, [(self.root, 0, -1)] if self.root is not None else []
        while todo:
            node, before, parent = todo.pop()
            leaf = isinstance(node, int)
            end = len(self.keys[node]) if leaf else before + len(node.prefix)
            own, some = (node, node) if leaf else (node.own, node.some)
            for depth in range(max(TURN, -(-before // TURN) * TURN), end + 1, TURN):
                yield parent, depth, own if depth == end else None, some
                parent, count = count, count + 1
            if not leaf:  # one byte leads to each child
                todo += [(child, end + 1, parent) for _, child in node.items()]


def _name(*parts: int | bytes) -> bytes:
    return md5(b"".join(struct.pack(">q", p) if isinstance(p, int) else p for p in parts)).digest()


ROOT = _name(0, 0, 0)


def _tree_rows(block: list[dict], band: int) -> list[dict]:
    """The nodes of one block of keys in order: done ones, and what it adds to the others.

    An item has band, c1 and c2 (digest of the bands before), n1 and n2 (with its own), key, chars of its turns,
    conv_id, n conversations, ends (digest of those that end with it, or null) and goes_on.
    """
    heads = [struct.pack(">qq", r["c1"], r["c2"]) for r in block]
    keys = [h + r["key"] for h, r in zip(heads, block, strict=True)]
    made = list(RadixTree(keys).nodes())
    size = len(made)
    open_keys = {k[:d] for i, k in enumerate(keys) if i in (0, len(keys) - 1) or block[i]["goes_on"] for d in range(TURN, len(k) + 1, TURN)}
    n, least, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    rows, opened = [], []
    for i, (_, depth, own, some) in enumerate(made):
        r, key = block[some], keys[some][:depth]
        turns, top = depth // TURN - 1, depth == TURN
        opened.append(top or key in open_keys)
        row = {"done": not opened[i], "depth": r["band"] * band + turns, "chars": 0 if top else r["chars"][turns - 1], "ends_sha256": None if own is None else block[own]["ends"]}
        if own is not None:
            n[i], least[i] = block[own]["n"], block[own]["conv_id"]
        if opened[i]:
            row["node"] = _name(r["band"], r["c1"], r["c2"]) if top else _name(r["band"] + 1, r["n1"], r["n2"]) if turns == band else _name(r["band"], key)
        rows.append(row)
    for i in range(size - 1, -1, -1):
        up = made[i][0]
        if not opened[i]:
            leaves[i] += not children[i]
            saved[i] += (n[i] - 1) * rows[i]["chars"]
        if up >= 0:
            n[up] += n[i]
            least[up] = least[i] if least[up] is None else min(least[up], least[i])
            if not opened[i]:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
    for i, row in enumerate(rows):
        up = made[i][0]
        later = made[i][1] == TURN and block[made[i][3]]["band"] > 0  # the band before counts its members
        row |= {"conv_id": None if later else least[i], "n_convs": 0 if later else n[i], "n_children": children[i], "n_leaves": leaves[i], "saved_tokens": saved[i]}
        if up >= 0:
            row |= {"parent": rows[up]["node"]} if opened[up] else {"parent_conv_id": least[up]}
    return rows


def _trees(block_keys: int, band: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for at in range(0, batch.num_rows, block_keys):
                held += batch.slice(at, block_keys).to_pylist()
                while len(held) >= block_keys:
                    yield pa.RecordBatch.from_pylist(_tree_rows(held[:block_keys], band), _NODES)
                    held = held[block_keys:]
        if held:
            yield pa.RecordBatch.from_pylist(_tree_rows(held, band), _NODES)

    return make


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns in order and the ranges they lie in.

    Turns: (conv_id, part, at, id, chars), at growing within a part. Ranges: (conv_id, part, low, before, size): the
    conversation's turns in a part begin at low, before of its size turns lie in parts before.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", "role", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("id"), F.length("text").cast("long").alias("chars"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    ranged = rows.repartitionByRange(*order, F.substring("role", 1, 32)).sortWithinPartitions(*order, "role", "id")
    kept = stored(ranged.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "id", "chars"))
    ranges = kept.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("count"))
    by = W.partitionBy("conv_id")
    before = F.coalesce(F.sum("count").over(by.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return kept, ranges.select("conv_id", "part", "low", before.alias("before"), F.sum("count").over(by).alias("size"))


def sequences(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, chars) of all turns, pos from 1, and (conv_id, size) of all conversations."""
    kept, ranges = turns(conversations)
    placed = kept.join(ranges.select("conv_id", "part", "low", "before"), ["conv_id", "part"])
    return placed.select("conv_id", (F.col("at") - F.col("low") + F.col("before") + 1).alias("pos"), "id", "chars"), ranges.select("conv_id", "size").distinct()


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sequences() with the first turns of each conversation taken from another: op13's made shared openings.

    The first h = crc32(conv_id) % 6 turns of c are those of conversation c - c % 100, or as many as there are.
    """
    kept, ranges = turns(conversations)
    base, asked = F.col("conv_id") - F.col("conv_id") % BASE, F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ranges = cut(ranges.select("*", base.alias("base"), asked.alias("h")))
    sizes = ranges.select("conv_id", "size", "base", "h").distinct()
    bases = sizes.where("conv_id = base").select("base", F.col("size").alias("base_size"))
    has = F.least("h", F.coalesce("base_size", F.lit(0).cast("long")))
    heads = ranges.where("conv_id = base").join(kept, ["conv_id", "part"]).select("base", (F.col("at") - F.col("low") + F.col("before") + 1).alias("pos"), "id", "chars").where(F.col("pos") < HEADS)
    opening = sizes.select("conv_id", "base", "h").join(heads, "base").where("pos <= h").select("conv_id", "pos", "id", "chars")
    own = kept.join(ranges.join(bases, "base", "left").select("conv_id", "part", "low", "before", "h", has.alias("has")), ["conv_id", "part"])
    own = own.select("conv_id", (F.col("at") - F.col("low") + F.col("before") + 1).alias("pos"), "id", "chars", "h", "has").where("pos > h")
    rest = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("has")).alias("pos"), "id", "chars")
    size = sizes.join(bases, "base", "left").select("conv_id", (F.greatest(F.col("size") - F.col("h"), F.lit(0)) + has).alias("size"))
    return opening.union(rest), size


def _bands(turns: DataFrame, band: int) -> DataFrame:
    """(conv_id, band, key, chars, c1, c2, n1, n2): turns in bands, stored; c and n are digests before and with the band."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "id", "chars")))
    bands = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / band).cast("long").alias("band")).agg(rows.alias("r"))
    key = F.unhex(F.array_join(F.transform("r", lambda x: x["id"]), ""))
    bands = stored(bands.select("conv_id", "band", key.alias("key"), F.col("r.chars").alias("chars")))
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    thin = bands.select("conv_id", "band", *(F.xxhash64(F.lit(k), "band", "key").alias(f"x{k}") for k in (1, 2)))
    thin = thin.select("conv_id", "band", *(F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")).alias(f"c{k}") for k in (1, 2)), "x1", "x2")
    thin = thin.select("conv_id", "band", "c1", "c2", *(F.col(f"c{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"n{k}") for k in (1, 2)))
    return bands.join(thin, ["conv_id", "band"])


def _ends(copies: DataFrame) -> DataFrame:
    """(x1, x2, size, conv_id, n, ends): how many conversations are the same, the smallest and the digest of their ids.

    Ids are put together in spans of IDS numbers first; the digest is then one stream over these.
    """
    same = ["x1", "x2", "size"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    spans = copies.groupBy(*same, F.floor(F.col("conv_id") / IDS).alias("span")).agg(ids.alias("ids"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    schema = pa.schema([*((c, pa.int64()) for c in (*same, "conv_id", "n")), ("ends", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or any(now[c] != r[c] for c in same):
                    if now:
                        out.append(now | {"ends": digest.hexdigest()})
                    now, digest = {c: r[c] for c in (*same, "conv_id")} | {"n": 0}, sha256(r["ids"].encode())
                else:
                    digest.update(f",{r['ids']}".encode())
                now["n"] += r["n"]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            yield pa.RecordBatch.from_pylist([now | {"ends": digest.hexdigest()}], schema)

    return spans.repartition(*same).sortWithinPartitions(*same, "span").mapInArrow(digests, from_arrow_schema(schema))


def _summed(open_nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved): sums over the subtrees of (node, parent, leaves, saved), by doubled steps to the root.

    After k rounds a node holds the sums of those below it within 2**k steps, and up is its ancestor that many above.
    """
    now = cut(open_nodes.select("node", F.col("parent").alias("up"), "leaves", "saved"))
    while not now.where("up is not null").isEmpty():
        more = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        # nodes that have come to the root don't move, and don't meet in one task for it
        moved = now.where("up is not null").join(above, "up").select("node", "next", "leaves", "saved")
        resting = now.where("up is null").select("node", F.col("up").alias("next"), "leaves", "saved")
        joined = moved.union(resting).join(more, "node", "left")
        now = cut(joined.select("node", F.col("next").alias("up"), *((F.col(c) + F.coalesce(c[0], F.lit(0).cast("long"))).alias(c) for c in ("leaves", "saved"))))
    return now.drop("up")


def prefix_trie(turns: DataFrame, sizes: DataFrame, *, block_keys: int = BLOCK, band: int = BAND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row per node.

    turns and sizes are as of sequences(). conv_id is a node's smallest member, n_convs counts members, n_leaves the
    childless nodes of its subtree (itself included), saved_tokens sums (n_convs - 1) times the code points of the last
    text over the subtree, and ends_sha256 is the digest of the ids of members that end there, in order, comma-joined.
    """
    bands = stored(_bands(turns, band))
    last = bands.join(sizes, "conv_id").where(F.col("band") == F.floor((F.col("size") - 1) / band))
    empty = sizes.where("size = 0").select("conv_id", F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "size")
    ends = stored(_ends(last.select("conv_id", F.col("n1").alias("x1"), F.col("n2").alias("x2"), "size").union(empty)))

    mine = bands.join(ends.where("size > 0").select("conv_id", "n", "ends", F.floor((F.col("size") - 1) / band).alias("end")), "conv_id")
    goes_on = F.col("band") < F.col("end")
    items = mine.groupBy("band", "c1", "c2", "n1", "n2", "key").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.min("chars").alias("chars"), F.max(F.when(~goes_on, F.col("ends"))).alias("ends"), F.bool_or(goes_on).alias("goes_on"))
    place = ["band", "c1", "c2", "key"]
    schema = from_arrow_schema(_NODES)
    found = stored(items.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(_trees(block_keys, band), schema))

    root = ends.where("size = 0").select(F.lit(ROOT).alias("node"), F.col("conv_id"), "n", F.col("ends").alias("ends_sha256"))
    zero = F.lit(0).cast("long")
    root = root.select("node", F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), "conv_id", F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"), zero.alias("chars"), "ends_sha256")
    parts = found.where("not done").select(root.columns).union(root)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = cut(parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256")))
    below = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    merged = merged.join(below, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", zero))
    merged = cut(merged.drop("more"))
    own = merged.select("node", "parent", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    owner = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("owner"))
    opened = merged.drop("n_leaves", "saved_tokens").join(_summed(own), "node").join(owner, "parent", "left")
    inside = found.where("done and parent is null").withColumn("owner", F.col("parent_conv_id"))
    below_open = found.where("done and parent is not null").join(owner, "parent")
    done = inside.unionByName(below_open)
    ends_here = F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    counts = ("n_convs", "n_children")
    return done.select("conv_id", "depth", F.col("owner").alias("parent_conv_id"), *counts, "n_leaves", "saved_tokens", ends_here).union(
        opened.select("conv_id", "depth", F.col("owner").alias("parent_conv_id"), *counts, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), ends_here)
    )
