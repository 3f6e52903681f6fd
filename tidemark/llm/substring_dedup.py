"""Substring de-duplication by repeated-phrase automata.

A window is WINDOW consecutive words of one document; words are runs without ASCII white space, unchanged. A word goes
if a window that covers it has a word sequence that also starts earlier: in a smaller (id, row), null ids first, or
earlier in the same document. Windows are judged on the texts as they come.

1. Texts are put in blocks of some BLOCK_BYTES. Documents of the same words are copies: of those with a window only
   the first is looked at, as every word of the others goes.
2. Each window has an anchor: the least hash of its runs of ANCHOR words. Equal windows have equal anchors, and
   neighbours mostly share one, so there is about one for seven words. Anchors are made distinct within a block, and
   those of two different documents, or standing twice in one, recur.
3. Only windows with a recurring anchor can recur. They are made distinct within a block, and meet in a shuffle by 128
   bits of their hash: recurring ones are confirmed, and each is known by the first place it stands at.
4. Each block gets the phrases that recur in it, as text from where they stand first. It compiles them into
   Aho-Corasick automata of SHARD_PHRASES each, and streams its documents through. A word is a letter there, so a
   phrase is a string of WINDOW letters and every match is a match of words. A match elsewhere than at the first place
   covers its words.

No pairs are listed, every shuffle is by hashes that blocks hold once, and a task holds one block and one automaton.

Null and empty texts have no words, and nothing is removed from texts of less than WINDOW words. Equal rows are copies:
one is left alone. Rows of the same id are ordered by where they stand in the table. Other columns are left alone. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import SPACE, mix, places, placed, shingle_hashes, slices, stored, text_or_empty, word_bounds, word_hashes

WINDOW, ANCHOR = 20, 8
BLOCK_BYTES = 2 << 20
#: Phrases of one automaton, and windows of a piece of text that phrases are cut from.
SHARD_PHRASES, PIECE = 20_000, 64
EMPTY = sha256(b"").hexdigest()
#: A document's number holds its task, its block in it and its place in that: bits of the last, and of the last two.
PLACE_BITS, BLOCK_BITS = 22, 42
#: A word is two letters, of a digit each: nodes of an automaton are searched through, so they should have few children.
DIGITS, HIGH = 128, 0x100
#: Salts of the two halves of a window's hash.
ONE, TWO = 21, 22

_DOCS = pa.schema([*((c, pa.int64()) for c in ("block", "uid", "doc_id", "n_words")), ("sha", pa.string()), ("same", pa.int64()), ("text", pa.string())])
_FOUND = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("block", "uid", "doc_id")), ("piece", pa.int32()), ("base", pa.int32()), ("text", pa.string()), *((c, pa.list_(pa.int64())) for c in ("h1", "uids", "ids", "at")), ("h2", pa.list_(pa.int32()))])
_SPANS = pa.schema([("uid", pa.int64()), ("removed", pa.int64()), ("kept_sha", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("kept", pa.string())])

#: DuckDB SQL for the rows of the query.
ORACLE_SQL = rf"""
WITH texts AS (
    SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
    SELECT r, i, words[i] AS word, CASE WHEN i + {WINDOW - 1} <= len(words) THEN sha256(array_to_string(words[i : i + {WINDOW - 1}], ' ')) END AS phrase FROM texts, unnest(range(1, len(words) + 1)) t(i)
), marked AS (
    SELECT *, phrase IS NOT NULL AND row_number() OVER (PARTITION BY phrase ORDER BY r, i) > 1 AS again FROM places
), covered AS (
    SELECT *, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM marked
), kept AS (
    SELECT r, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS text FROM covered GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM texts LEFT JOIN kept k USING (r)
"""


class Words:
    """The words of some texts: their bounds, hashes and windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = word_bounds(data, offsets, SPACE)
        self.hashes = word_hashes(data, self.starts, self.ends)
        self.grams, self.begin = shingle_hashes(self.hashes, self.first, ANCHOR)
        n = np.diff(self.first)
        self.n = n
        count = np.maximum(n - WINDOW + 1, 0)
        self.text, self.at = np.repeat(np.arange(len(n)), count), places(count)
        least, wide = self.grams, 1
        while 2 * wide <= WINDOW - ANCHOR + 1:
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        rest = WINDOW - ANCHOR + 1 - wide
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest and len(least) > rest else least
        at = np.repeat(self.begin[:-1], count) + self.at
        #: The anchor of each window; text and at say where the window stands.
        self.anchors = least[at] if len(at) else np.zeros(0, np.uint64)

    def windows(self, chosen: np.ndarray, salt: int) -> np.ndarray:
        """Hashes of some windows, by their numbers."""
        start, out = self.first[self.text[chosen]] + self.at[chosen], np.zeros(len(chosen), np.uint64)
        for i in range(WINDOW):
            out = mix(out + placed(self.hashes[start + i], np.full(1, i), salt))
        return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """The documents with their block, row number, words and digest of the words, stored."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, place = TaskContext.get().partitionId() << BLOCK_BITS - PLACE_BITS, 0, 0
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                raw, uids, counts, digests = data.tobytes(), [], [], []
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if size and size + e - s > block_bytes or place >> PLACE_BITS:
                        block, size, place = block + 1, 0, 0
                    size += e - s
                    uids.append(block << PLACE_BITS | place)
                    place += 1
                    words = raw[s:e].split()
                    counts.append(len(words))
                    digests.append(sha256(b" ".join(words)))
                same = np.frombuffer(b"".join(d.digest()[:8] for d in digests), "<i8")
                columns = [pa.array([u >> PLACE_BITS for u in uids]), pa.array(uids), part.column(0), pa.array(counts), pa.array([d.hexdigest() for d in digests]), pa.array(same), part.column(1)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _DOCS, strict=True)], schema=_DOCS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stored(rows.mapInArrow(make, from_arrow_schema(_DOCS)))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, h, same, multi): the distinct anchors of each block; multi: in two documents or twice in one."""
    held: list[tuple[np.ndarray, ...]] = []
    block = None

    def out() -> pa.RecordBatch:
        h, same, multi = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((same, h))
        h, same, multi = h[order], same[order], multi[order]
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        more = np.zeros(len(h), bool)
        more[1:] = ~new[1:] & (same[1:] != same[:-1])
        multi = np.logical_or.reduceat(multi | more, at) if len(at) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(h[at].view(np.int64)), pa.array(same[at]), pa.array(multi)], ["block", "h", "same", "multi"])

    for batch in batches:
        blocks = np.asarray(batch.column(0))
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
        for at, to in zip(cuts, [*cuts[1:], len(blocks)], strict=True):
            if held and blocks[at] != block:
                yield out()
                held = []
            block = int(blocks[at])
            for part, data, offsets in slices(batch.slice(at, to - at), "text"):
                words, same = Words(data, offsets), np.asarray(part.column(1))
                # a gram and its document as one number: numbers that stand twice are grams that stand twice
                owner = np.repeat(np.arange(len(words.begin) - 1), np.diff(words.begin))
                grams = np.sort(mix(words.grams ^ mix(owner.astype(np.uint64) + np.uint64(1))))
                twice = grams[1:][grams[1:] == grams[:-1]]
                own, where = np.unique(mix(words.anchors ^ mix(words.text.astype(np.uint64) + np.uint64(1))), return_index=True)
                held.append((words.anchors[where], same[words.text[where]], np.isin(own, twice)))
    if held:
        yield out()


def _candidates(docs: pa.Table, side: pa.Table) -> pa.Table:
    """What a block holds of windows with a recurring anchor.

    side: the recurring anchors, and the rows that are the first of their words. Rows of kind 0 are documents with such
    windows, of kind 1 pieces of text with the words of up to PIECE of them, of kind 2 the distinct windows.
    """
    hashes = np.asarray(side["h"].drop_null()).view(np.uint64)
    docs = docs.filter(pc.is_in(docs["uid"], value_set=side["uid"].combine_chunks().drop_null()))
    out, found = [], []
    for batch in docs.combine_chunks().to_batches() if len(hashes) else []:
        for part, data, offsets in slices(batch, "text"):
            words = Words(data, offsets)
            chosen = np.flatnonzero(np.isin(words.anchors, hashes))
            if not len(chosen):
                continue
            text, at = words.text[chosen], words.at[chosen]
            uid, doc_id, texts = part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3)
            block, raw = part.column(0)[0].as_py(), data.tobytes()
            for t in np.unique(text).tolist():
                out.append({"kind": 0, "block": block, "uid": uid[t], "doc_id": doc_id[t], "text": texts[t].as_py()})
            piece = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (at[1:] // PIECE != at[:-1] // PIECE)))
            for a, b in zip(piece.tolist(), [*piece[1:].tolist(), len(text)], strict=True):
                t, base = int(text[a]), int(at[a])
                start, end = words.first[t] + base, words.first[t] + int(at[b - 1]) + WINDOW - 1
                kept = raw[words.starts[start] : words.ends[end]]
                out.append({"kind": 1, "block": block, "uid": uid[t], "piece": base // PIECE, "base": base, "text": kept.decode()})
            ids = np.array([-1 if x is None else x for x in doc_id], np.int64)
            none = np.array([x is None for x in doc_id])
            found.append((words.windows(chosen, ONE), words.windows(chosen, TWO).astype(np.uint32).view(np.int32), ~none[text], ids[text], np.array(uid, np.int64)[text], at))
    if found:
        h1, h2, named, ids, uids, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, uids, ids, named, h2, h1))
        new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))
        first = np.flatnonzero(new)
        multi = np.zeros(len(h1), np.int64)
        multi[order[first]] = np.diff(np.append(first, len(h1))) > 1
        first = np.sort(order[first])  # in the order of texts, which compresses better
        for i in range(0, len(first), 4096):
            x = first[i : i + 4096]
            known = [v if k else None for v, k in zip(ids[x].tolist(), named[x].tolist(), strict=True)]
            out.append({"kind": 2, "block": block, "h1": h1[x].view(np.int64), "h2": h2[x], "uids": uids[x], "ids": known, "at": at[x] << 1 | multi[x]})
    return pa.Table.from_pylist(out, _FOUND)


def spelling(i: int) -> str:
    """The two letters of word number i."""
    high = HIGH + i // DIGITS
    return chr(high if high < 0xD800 else high + 0x800) + chr(1 + i % DIGITS)  # surrogates are no characters


def shards(phrases: list[tuple[str, list[int], int, int]], most: int) -> Iterator[object]:
    """Automata of at most so many phrases each.

    phrases: a piece of text in letters, the places in its document of the windows asked for, the place of its first
    word, and the document's number. Each phrase leads to (number, place).
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for letters, asked, base, uid in phrases:
        for at in asked:
            automaton.add_word(letters[2 * (at - base) : 2 * (at - base + WINDOW)], (uid, at))
        if len(automaton) >= most:
            automaton.make_automaton()
            yield automaton
            automaton = ahocorasick.Automaton()
    if len(automaton):
        automaton.make_automaton()
        yield automaton


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


def _located(most: int, with_text: bool):
    """The documents of a block streamed through its automata: what is covered in each."""

    def locate(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        letters: dict[str, str] = {}
        asked = []
        for p in phrases.to_pylist():
            for w in (own := _split(p["text"])):
                if w not in letters:
                    letters[w] = spelling(len(letters))
            asked.append(("".join([letters[w] for w in own]), p["asked"], p["base"], p["fuid"]))
        rows = docs.select(["uid", "text"]).to_pylist()
        words = [_split(r["text"]) for r in rows]
        spelt = ["".join([letters.get(w, "\0\0") for w in own]) for own in words]
        covered = [np.zeros(len(w) + 1, np.int32) for w in words]
        for automaton in shards(asked, most):
            for r, own, marks in zip(rows, spelt, covered, strict=True):
                uid = r["uid"]
                hits = [end // 2 for end, (fuid, at) in automaton.iter(own) if fuid != uid or at != end // 2 - WINDOW + 1]
                if hits:
                    np.add.at(marks, np.array(hits) - WINDOW + 1, 1)
                    np.add.at(marks, np.array(hits) + 1, -1)
        out = []
        for r, own, marks in zip(rows, words, covered, strict=True):
            gone = np.cumsum(marks[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
            kept = " ".join(w for w, x in zip(own, gone.tolist(), strict=True) if not x)
            spans = [{"s": s, "e": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            out.append({"uid": r["uid"], "removed": int(gone.sum()), "kept_sha": sha256(kept.encode()).hexdigest(), "spans": spans, "kept": kept if with_text and spans else None})
        return pa.Table.from_pylist(out, _SPANS)

    return locate


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES, shard_phrases: int = SHARD_PHRASES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans): one row per document.

    spans are the removed runs of words, from 0, end exclusive. kept_sha256 is the digest of the kept words joined by
    single blanks. with_text: a column text follows, those words, or the text as it is if nothing went.
    """
    table = _blocks(docs, id_col, text_col, block_bytes)
    long = table.where(F.col("n_words") >= WINDOW)
    reps = long.groupBy("sha").agg(F.min(F.struct("doc_id", "uid", "block")).alias("r")).select("r.uid", "r.block")

    anchors = long.select("block", "same", "text").mapInArrow(_anchors, "block long, h long, same long, multi boolean")
    by = W.partitionBy("h")
    recurring = anchors.select("block", "h", ((F.min("same").over(by) != F.max("same").over(by)) | F.max("multi").over(by)).alias("recurs")).where("recurs")
    none, own_block = F.lit(None).cast("long"), F.col("block").alias("block")  # a column of its own beside the other side's
    side = recurring.select("block", "h", none.alias("uid")).union(reps.select("block", none, "uid"))

    found = stored(long.select(own_block, "uid", "doc_id", "text").groupBy("block").cogroup(side.groupBy("block")).applyInArrow(_candidates, from_arrow_schema(_FOUND)))
    windows = found.where("kind = 2").select(F.inline(F.arrays_zip("h1", "h2", "uids", "ids", "at")).alias("h1", "h2", "uid", "doc_id", "at"))
    by = W.partitionBy("h1", "h2")
    first = F.min(F.struct("doc_id", "uid", "at")).over(by)
    repeated = windows.select("uid", "at", first.alias("f"), (F.col("at") % 2 == 1).alias("multi"), (F.count("*").over(by) > 1).alias("more"))
    # a block asks for the phrases that stand in it but not only at their first place
    repeated = repeated.where(F.col("multi") | (F.col("more") & ((F.col("uid") != F.col("f.uid")) | (F.col("at") != F.col("f.at")))))
    repeated = repeated.select(F.shiftright("uid", PLACE_BITS).alias("block"), F.col("f.uid").alias("fuid"), F.shiftright("f.at", 1).cast("int").alias("pos"))
    asked = repeated.groupBy("block", "fuid", F.floor(F.col("pos") / PIECE).cast("int").alias("piece")).agg(F.collect_list("pos").alias("asked"))
    pieces = found.where("kind = 1").select(F.col("uid").alias("fuid"), "piece", "base", "text")
    phrases = asked.join(pieces, ["fuid", "piece"]).select("block", "fuid", "base", "text", "asked")

    spans = "array<struct<s: long, e: long>>"
    located = found.where("kind = 0").select(own_block, "uid", "text").groupBy("block").cogroup(phrases.groupBy("block")).applyInArrow(_located(shard_phrases, with_text), from_arrow_schema(_SPANS))

    joined = table.select("uid", "doc_id", "n_words", "sha", *(["text"] if with_text else [])).join(reps.select("uid", F.lit(True).alias("rep")), "uid", "left").join(located, "uid", "left")
    copy = (F.col("n_words") >= WINDOW) & F.col("rep").isNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), F.col("n_words").alias("e")))
    return joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, EMPTY).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(spans))).alias("spans"),
        *([F.when(copy, "").otherwise(F.coalesce("kept", "text")).alias("text")] if with_text else []),
    )
