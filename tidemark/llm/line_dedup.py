"""Line de-duplication by a deletion-neighbourhood join.

A line is its words: runs without ASCII white space, A-Z lower-cased. Two lines of at least min_words words are near
if one word inserted, deleted or replaced turns one into the other; shorter lines are the same only if equal. A line
place is dropped if an earlier place holds the same line, or if the earliest place of a near line is before the
earliest place of its own line. Earlier means the smaller (id, row key, line number), null ids first.

A line is known by 128 bits of the BLAKE2b digest of its words. Lines emit every variant with one word deleted, as a
128-bit key with the deleted position, and themselves undeleted. Same variant, same position: one replaced word.
Undeleted line equal to a variant: one inserted word. Lines that meet so are joined to the earliest line of their
variants, which is an aggregate: no pairs are listed. The words of a line and of that earliest one are then compared,
and the line goes only if they are one edit apart. Only lines that share their first or their last words with another
line can have a near one (one edit leaves one of the two ends alone), so only those emit variants. Ends are a quarter
to a half of the shorter line, in steps (edge_words), so few other lines pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, mix, placed, places, slices, stored, text_or_empty, totals, word_bounds, word_hashes

#: Lines from this many words on are compared for near ones; two words are the least that leaves an end alone.
MIN_WORDS, LEAST_WORDS = 6, 2
#: Words of an end of lines from 2, 4, 6 and 10 words on; from there on they double with the line.
EDGES = ((2, 1), (4, 2), (6, 3), (10, 5))
ENDS = ("head", "tail", "low_head", "low_tail")
#: A line's digest, in two halves.
LINE = ["line", "line2"]
#: Names of columns of its own beside those of docs.
ROW, OWN, GONE, LINES = "__tidemark_row", "__tidemark_id", "__tidemark_gone", "__tidemark_lines"
#: Salts of the two halves of a variant's key, and of the ends.
KEY, CHECK, HEAD, TAIL = 11, 12, 13, 14


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, word starts and ends; for each line with words: text, line number, first and one past its last word."""
    low = LOWER[data]
    starts, ends, _ = word_bounds(data, offsets, SPACE)
    breaks = np.flatnonzero(data == 0x0A)
    text = np.searchsorted(offsets, starts, "right") - 1
    line = np.searchsorted(breaks, starts)
    new = np.ones(len(starts), bool)
    new[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) if len(first) else first
    return low, starts, ends, text[first], line[first] - np.searchsorted(breaks, offsets[text[first]]), first, last


def _normal(low: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """Each line's words with single blanks."""
    return [b" ".join(low[s:e].split()) for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _digests(lines: list[bytes]) -> tuple[pa.Array, pa.Array]:
    halves = np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in lines), "<i8").reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def edge_words(n: np.ndarray) -> np.ndarray:
    """Words of the ends that two near lines are compared by, of which the shorter has n (LEAST_WORDS or more).

    At most n / 2: one edit then leaves the first or the last of them alone in both lines.
    """
    least, most = EDGES[-1]
    steps = np.frexp(np.maximum(n // least, 1))[1] - 1
    return np.select([n < least_next for (least_next, _) in EDGES[1:]], [words for _, words in EDGES[:-1]], most << steps.astype(np.int64))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rk, at, *LINE, *ENDS): the lines with words of every text.

    Ends are null for lines under min_words. A line can be the longer or the shorter of two near ones, so where a line
    of one word less has shorter ends, low_head and low_tail are those; elsewhere they are null.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                low, starts, ends, text, at, first, last = _lines(data, offsets)
                words, n = word_hashes(low, starts, ends), last - first
                digest = _digests(_normal(low.tobytes(), starts[first], ends[last - 1]))
                from_start, from_end = places(n), np.repeat(n, n) - 1 - places(n)
                heads, tails = totals(placed(words, from_start, HEAD)), totals(placed(words, from_end, TAIL))
                made = []
                own, lower = edge_words(n), edge_words(n - 1)
                for edge, asked in ((own, n >= min_words), (lower, (n > min_words) & (lower < own))):
                    size = np.minimum(n, edge)
                    for x in (heads[first + size] - heads[first], tails[last] - tails[last - size]):
                        made.append(pa.array(mix(x + size.astype(np.uint64)).view(np.int64), mask=~asked))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at.astype(np.int32)), *digest, *made], ["id", "rk", "at", *LINE, *ENDS])

    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("rk"), text_or_empty(text_col).alias("text"))
    long, integer = T.LongType(), T.IntegerType()
    out = [("id", rows.schema["id"].dataType), ("rk", long), ("at", integer), *((x, long) for x in (*LINE, *ENDS))]
    return rows.mapInArrow(make, T.StructType([T.StructField(*x) for x in out]))


def _row_key(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, check, pos, *LINE, words) of the named lines of each text.

    pos is the deleted word's place, or -1 for the whole line, where words has its words with single blanks.
    """
    for batch in batches:
        for part, data, offsets in slices(batch, "text"):
            low, starts, ends, text, at, first, last = _lines(data, offsets)
            asked = part.column(1)
            want = np.repeat(np.arange(len(asked)), np.diff(np.asarray(asked.offsets)))
            key = want.astype(np.int64) << 32 | np.asarray(asked.flatten()).astype(np.int64)
            hit = np.flatnonzero(np.isin(text.astype(np.int64) << 32 | at.astype(np.int64), key))
            hashes, whole = word_hashes(low, starts, ends), low.tobytes()
            for some in np.array_split(hit, max(1, len(hit) // 500)):
                b, n = first[some], last[some] - first[some]
                lines = _normal(whole, starts[b], ends[b + n - 1])
                digest = _digests(lines)
                own = places(n)
                words = hashes[np.repeat(b, n) + own]
                begin = np.cumsum(n) - n
                rows = np.repeat(np.arange(len(some)), n + 1)
                pos = places(n + 1)
                deleted = pos < n[rows]
                cut = begin[rows] + np.minimum(pos, n[rows])
                keys = []
                for salt in (KEY, CHECK):
                    stay, moved = totals(placed(words, own, salt)), totals(placed(words, own - 1, salt))  # behind the deleted word
                    end = begin[rows] + n[rows]
                    left, right = stay[cut] - stay[begin[rows]], moved[end] - moved[np.minimum(cut + 1, end)]
                    keys.append(pa.array(mix(left + right + (n[rows] - deleted).astype(np.uint64)).view(np.int64)))
                take = pa.array(rows)
                kept = pa.array(np.where(deleted, -1, rows), mask=deleted)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.where(deleted, pos, -1).astype(np.int32)), *(d.take(take) for d in digest), pa.array(lines, pa.binary()).take(kept)], ["key", "check", "pos", *LINE, "words"])


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one word inserted, deleted or replaced turns one line into the other, or they are equal."""
    x, y = a.split(), b.split()
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), len(x))
    return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i:] == y[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines whose words are one edit from those of the other line."""
    for batch in batches:
        good = [one_edit(a, b) for a, b in zip(batch.column("words").to_pylist(), batch.column("others").to_pylist(), strict=True)]
        yield batch.select(LINE).filter(pa.array(good, pa.bool_()))


def near_lines(variants: DataFrame, firsts: DataFrame) -> DataFrame:
    """LINE of every line that has a near line of an earlier first place."""
    often = variants.groupBy("key", "check").agg(F.count("*").alias("n")).where("n > 1").select("key", "check")
    met = stored(variants.drop("words").join(often, ["key", "check"]).distinct().join(firsts.select(*LINE, "first"), LINE))
    same = met.groupBy("key", "check", "pos").agg(F.min(F.struct("first", *LINE)).alias("same"))
    of_key = same.groupBy("key", "check").agg(F.min(F.when(F.col("pos") < 0, F.col("same"))).alias("whole"), F.min(F.when(F.col("pos") >= 0, F.col("same"))).alias("part"))
    joined = met.join(same, ["key", "check", "pos"]).join(of_key, ["key", "check"])
    # a line with a deleted word meets others with that word deleted, and whole lines; a whole line meets those with a deleted word
    other = F.when(F.col("pos") >= 0, F.least("same", "whole")).otherwise(F.col("part"))
    earlier = joined.withColumn("other", other).where("other.first < first").groupBy(*LINE).agg(F.min("other").alias("other"))
    texts = variants.where("pos < 0").select(*LINE, "words")
    others = texts.select(F.col("line").alias("other_line"), F.col("line2").alias("other_line2"), F.col("words").alias("others"))
    pairs = earlier.select(*LINE, F.col("other.line").alias("other_line"), F.col("other.line2").alias("other_line2"))
    both = pairs.join(texts, LINE).join(others, ["other_line", "other_line2"])
    return both.select(*LINE, "words", "others").mapInArrow(_verified, "line long, line2 long").distinct()


def dropped_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, rk, dropped): for each row that loses lines, the numbers of those lines."""
    if min_words < LEAST_WORDS:
        raise ValueError(f"min_words must be {LEAST_WORDS} at least")
    lines = stored(line_table(docs, id_col, text_col, min_words))
    place = F.struct("id", "rk", "at")
    firsts = stored(lines.groupBy(*LINE).agg(F.min(place).alias("first"), F.count("*").alias("n")))

    # the gate may pass a line in vain, so half a digest is enough for it
    ends = lines.where("head is not null").select("line", F.explode(F.array_compact(F.array(*ENDS))).alias("value"))
    shared = ends.groupBy("value").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("value")
    gated = ends.join(shared, "value", "left_semi").select("line").distinct()

    asked = firsts.join(gated, "line", "left_semi").groupBy(F.col("first.rk").alias(ROW)).agg(F.collect_list("first.at").alias("asked"))
    # the lines of one text are named together, so this list is as long as a text at most
    named = docs.select(text_col, _row_key(id_col, text_col).alias(ROW)).join(asked, ROW)
    variants = stored(named.select(text_or_empty(text_col).alias("text"), "asked").mapInArrow(_variants, "key long, check long, pos int, line long, line2 long, words binary"))
    near = near_lines(variants, firsts).withColumn("near", F.lit(True))

    # a table of its own, so that the next join has two plain shuffled sides and Spark can split a hot line
    decided = stored(firsts.join(near, LINE, "left").where("n > 1 or near").select(*LINE, "first", "near"))
    gone = lines.select(*LINE, "id", "rk", "at").join(decided, LINE).where(F.coalesce("near", F.lit(False)) | (F.col("first") < place))
    return gone.groupBy("id", "rk").agg(F.collect_set("at").alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs, their text without dropped lines, and n_lines and n_dropped.

    Lines of min_words words or more also go for an earlier line that is one word edit away; LEAST_WORDS is the least.

    Kept lines stay as they are and in order, joined by newlines; lines without words are never dropped. A null text
    stays null with no lines. Rows of the same id and text are one document: they keep and lose the same lines and do
    not drop each other's. An empty table gives an empty table. All other columns pass through; a column of docs named
    n_lines or n_dropped is replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_lines(docs, id_col, text_col, min_words).select(F.col("rk").alias(ROW), F.col("id").alias(OWN), F.col("dropped").alias(GONE))
    keyed = docs.select(*names, _row_key(id_col, text_col).alias("__tidemark_key"))
    met = (F.col("__tidemark_key") == F.col(ROW)) & F.col(id_col).eqNullSafe(F.col(OWN))
    joined = keyed.join(gone, met, "left").withColumn(LINES, F.split(F.col(text_col).cast("string"), "\n", -1))
    # the numbers that stay come from a hash set difference, so long texts take time in proportion to their lines
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(LINES) - 1), F.col(GONE)), lambda i: F.col(LINES)[i])
    kept = F.when(F.col(GONE).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *(kept.alias(c) if c == text_col else F.col(c) for c in names),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(LINES)).cast("long").alias("n_lines"),
        F.coalesce(F.size(GONE), F.lit(0)).cast("long").alias("n_dropped"),
    )
