"""Persistent event clustering: new documents join open clusters of a shared code, or open new ones.

Documents and clusters whose codes meet are one block; blocks are independent and fold side by side. Cluster ids are
hashes of the first document, so they stay when sources join and are the same in every run.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.session import cut, spread
from .folds import _blocks, in_blocks, in_runs, indel_ratio

# Fixed values of the merge test.
MERGE_SECONDS, HISTORY_SECONDS = 72 * 3600, 180 * 86_400
TITLE_LIKENESS, TRIGRAM_LIKENESS, EXCERPT = 90.0, 0.82, 120
#: Texts of a cluster up to which each is compared, rather than those that share a leading gram.
FEW_TEXTS = 16
APPROVED = re.compile(r"获批|批准|注册证|批件|上市许可|药品注册|批文|许可证")
REPORT, SUMMARY, BUYBACK = re.compile("报告"), re.compile("摘要"), re.compile("回购")


def features(documents: DataFrame) -> DataFrame:
    """Adds the normal title, report period, amounts, targets, dates and the text whose trigrams are compared, all by
    built-in functions. The fold takes the trigrams: as arrays they are many times the text that is shuffled."""
    title, body, text = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), F.col("__text")
    lead = F.substring(F.regexp_replace(body, r"\s+", ""), 1, EXCERPT)
    out = documents.withColumns({"norm": X.normalize_title(title), "__text": F.concat_ws("\n", title, body)})
    return out.withColumns({"period": X.report_period(title), "amounts": X.amounts(text), "targets": X.targets(text), "dates": X.dates_in(text), "said": F.concat_ws("\n", "norm", lead)}).drop("__text")


_EMPTY = frozenset()
_NO_FACTS = (_EMPTY,) * 3


class _Document:
    """A row of the fold, with what the tests derive from it."""

    __slots__ = ("t", "document_id", "norm", "url", "content_hash", "kind_hint", "codes", "said", "event_id", "facts", "families")
    FIELDS = ("t", "document_id", "title", "norm", "period", "url", "content_hash", "kind_hint", "codes", "amounts", "targets", "dates", "said", "event_id")

    def __init__(self, t, document_id, title, norm, period, url, content_hash, kind_hint, codes, amounts, targets, dates, said, event_id):
        self.t, self.document_id, self.norm, self.url, self.content_hash, self.kind_hint, self.codes, self.said, self.event_id = t, document_id, norm, url, content_hash, kind_hint, codes, said or "", event_id
        self.facts = (_set(amounts), _set(targets), _set(dates)) if amounts or targets or dates else _NO_FACTS
        self.families = self._families(title, period) if title else _EMPTY

    def _families(self, title: str, period: str | None) -> set[tuple] | frozenset:
        """(day, kind, what) of the matters of a day that a document stands for."""
        out, day = [], self.t // 86_400
        if self.norm and APPROVED.search(title):
            out.append((day, "approval", self.norm))
        if period and REPORT.search(title):
            out.append((day, "summary" if SUMMARY.search(title) else "report", period))
        if BUYBACK.search(title):
            out.append((day, "buyback", ""))
        return set(out) if out else _EMPTY

    def partners(self) -> set[tuple]:
        """The matters whose documents a document belongs to: a report's are its summaries, and the other way round."""
        swap = {"summary": "report", "report": "summary"}
        return {(day, swap.get(kind, kind), what) for day, kind, what in self.families}


def _set(x) -> frozenset:
    return frozenset(() if x is None else x)


class _Cluster:
    """What a cluster's documents say, kept as unions and indexes, so that a test doesn't read the documents again."""

    __slots__ = ("id", "past", "gone", "documents", "codes", "kinds", "urls", "hashes", "facts", "first", "last", "families", "norms", "said", "grams", "by_gram", "indexed")

    def __init__(self, key: str, past: str | None):
        self.id, self.past, self.gone = key, past, False
        self.documents: dict[str, int] = {}
        self.codes: set[str] = set()
        self.kinds = self.urls = self.hashes = _EMPTY  # sets once they hold something, as families
        self.facts = _NO_FACTS
        self.first = self.last = None
        self.families: set[tuple] | frozenset = _EMPTY  # (day, kind, what) of approvals, reports, summaries and buybacks
        self.norms: dict[int, set[str]] = {}  # by length
        self.said: dict[str, None] = {}  # distinct texts, in order
        self.grams: list[frozenset] = []  # of the first texts: those that a test has come to
        self.by_gram: dict[str, list[int]] = {}  # of the first grams: once there are many
        self.indexed = 0

    def add(self, r: _Document) -> None:
        if r.document_id in self.documents:
            return
        self.documents[r.document_id] = r.t
        self.codes.update(r.codes)
        if self.first is None or r.t < self.first:
            self.first = r.t
        if self.last is None or r.t > self.last:
            self.last = r.t
        if r.facts is not _NO_FACTS:
            self.facts = _union(self.facts, r.facts)
        if r.families:
            self.families = _grown(self.families, r.families)
        if r.kind_hint:
            self.kinds = _grown(self.kinds, (r.kind_hint,))
        if r.url:
            self.urls = _grown(self.urls, (r.url,))
        if r.content_hash:
            self.hashes = _grown(self.hashes, (r.content_hash,))
        if r.norm:
            self.norms.setdefault(len(r.norm), set()).add(r.norm)
        self.said[r.said] = None

    def take(self, other: _Cluster) -> None:
        """All that another cluster holds."""
        self.documents |= other.documents
        self.first, self.last = min(self.first, other.first), max(self.last, other.last)
        self.facts = _union(self.facts, other.facts)
        for name in ("codes", "kinds", "urls", "hashes", "families"):
            setattr(self, name, _grown(getattr(self, name), getattr(other, name)))
        for n, norms in other.norms.items():
            self.norms.setdefault(n, set()).update(norms)
        self.said |= other.said

    def alike(self, r: _Document) -> bool:
        """The merge test in order: family, conflict of facts, URL, content, title, trigrams, facts."""
        if r.families and self.families and not r.partners().isdisjoint(self.families):
            return True
        facts = () if r.facts is _NO_FACTS or self.facts is _NO_FACTS else list(zip(r.facts, self.facts, strict=True))
        if facts and any(a and b and a != b for a, b in facts):
            return False
        if r.url in self.urls or r.content_hash in self.hashes:
            return True
        return self._title(r.norm) or self._text(r.said) or r.kind_hint in self.kinds and any(a and b for a, b in facts)

    def _title(self, norm: str) -> bool:
        """Titles are alike only if their lengths are: the common part is no longer than the shorter one."""
        n = len(norm or "")
        if not n:
            return False
        if norm in self.norms.get(n, ()):
            return True
        for m, held in self.norms.items():
            if 200.0 * min(n, m) >= TITLE_LIKENESS * (n + m) and any(_title_ratio(norm, x) >= TITLE_LIKENESS for x in held):
                return True
        return False

    def _text(self, said: str) -> bool:
        if len(said) < 3:
            return False
        if said in self.said:
            return True
        grams = _grams(said)
        if len(self.grams) < len(self.said):
            self.grams += [_grams(x) for x in islice(self.said, len(self.grams), None)]
        if len(self.grams) <= FEW_TEXTS:
            met = range(len(self.grams))
        else:
            for i in range(self.indexed, len(self.grams)):
                for g in _leading(self.grams[i]):
                    self.by_gram.setdefault(g, []).append(i)
            self.indexed = len(self.grams)
            met = {i for g in _leading(grams) for i in self.by_gram.get(g, ())}
        n = len(grams)
        for i in met:
            held = self.grams[i]
            # as many in common as the smaller set has would have to do
            if held and min(n, len(held)) / (n * len(held)) ** 0.5 >= TRIGRAM_LIKENESS and len(grams & held) / (n * len(held)) ** 0.5 >= TRIGRAM_LIKENESS:
                return True
        return False


@lru_cache(1 << 12)
def _grams(said: str) -> frozenset:
    """The distinct runs of three characters."""
    return frozenset(said[i : i + 3] for i in range(len(said) - 2))


_title_ratio = lru_cache(1 << 14)(indel_ratio)


def _grown(held: set | frozenset, more) -> set | frozenset:
    """held with more in it: the same set, unless it is the empty one that all share."""
    if held is _EMPTY:
        return set(more) if more else held
    held.update(more)
    return held


def _union(a: tuple, b: tuple) -> tuple:
    return tuple(x | y if y else x for x, y in zip(a, b, strict=True))


def _leading(grams: frozenset) -> list[str]:
    """The first grams, in an order of all grams, of which two alike sets have one in common."""
    n = len(grams)
    least = math.ceil(n * TRIGRAM_LIKENESS**2 - 1e-9)
    return sorted(grams, key=lambda g: (zlib.crc32(g.encode()), g))[: n - least + 1]


class _Events:
    """The clusters of a block, found by their codes. Those that can't change any more give up their documents, and those
    too old for the history are forgotten."""

    def __init__(self):
        self.by_code: dict[str, list[_Cluster]] = defaultdict(list)
        self.home: dict[str, _Cluster] = {}
        self.open: dict[int, _Cluster] = {}

    def opened(self, key: str, r: _Document, past: str | None = None) -> _Cluster:
        c = _Cluster(key, past)
        self.open[id(c)] = c
        self.join(c, r)
        return c

    def join(self, c: _Cluster, r: _Document) -> None:
        if r.document_id not in c.documents:
            codes = set(r.codes) - c.codes
            c.add(r)
            self._find_by(c, codes)
        self.home[r.document_id] = c

    def _find_by(self, c: _Cluster, codes: set[str]) -> None:
        for code in codes:
            self.by_code[code].append(c)

    def merge(self, keep: _Cluster, gone: _Cluster) -> None:
        before = set(keep.codes)
        keep.take(gone)
        self._find_by(keep, keep.codes - before)
        for d in gone.documents:
            self.home[d] = keep
        gone.gone = True
        self.open.pop(id(gone), None)

    def of(self, r: _Document) -> list[_Cluster]:
        """Clusters that share a code with a row and are no older than the history."""
        since, codes, found = r.t - HISTORY_SECONDS, set(r.codes), {}
        for code in codes:
            held = self.by_code.get(code)
            if held:
                live = self.by_code[code] = [c for c in held if not c.gone and c.last >= since]
                if len(codes) == 1:
                    return live[:]
                found |= {id(c): c for c in live}
        return list(found.values())

    def settled(self, before: int) -> list[tuple]:
        """The rows of clusters whose last document is before a time; they stay for the history, without documents."""
        out = []
        for key, c in [(k, c) for k, c in self.open.items() if c.last < before]:
            out += [(d, c.id, c.past) for d in c.documents]
            for d in c.documents:
                del self.home[d]
            c.documents = {}
            del self.open[key]
        return out

    def rest(self) -> list[tuple]:
        """The rows of all that is still open, at the end."""
        return [(d, c.id, c.past) for c in self.open.values() for d in c.documents]

    def forget(self, before: int) -> None:
        """Leaves out clusters too old for the history, also under codes that don't come up again."""
        for code in list(self.by_code):
            live = [c for c in self.by_code[code] if not c.gone and c.last >= before]
            if live:
                self.by_code[code] = live
            else:
                del self.by_code[code]


class _Fold:
    """The fold of one block in order of time and id; done rows come out on the way."""

    def __init__(self, restored: list[_Document] = ()):
        self.events, self.known = _Events(), {}
        for r in restored:  # documents that already belong to a cluster restore it
            if r.event_id is not None and r.document_id not in self.events.home:
                if r.event_id in self.known:
                    self.events.join(self.known[r.event_id], r)
                else:
                    self.known[r.event_id] = self.events.opened(r.event_id, r)

    def take(self, r: _Document) -> None:
        events = self.events
        own, found = events.home.get(r.document_id), events.of(r)
        since = r.t - MERGE_SECONDS
        near = [c for c in found if c is not own and c.last >= since]
        if len(near) > 1:
            near.sort(key=lambda c: (-c.last, c.id))
        for c in near:
            if not c.alike(r):
                continue
            if own is None:
                events.join(c, r)
                own = c
            else:  # the document ties two clusters: the larger, then earlier, then smaller id survives
                keep, gone = sorted((own, c), key=lambda x: (-len(x.documents), x.first, x.id))
                events.merge(keep, gone)
                own = keep
        if own is None:
            older = [c for c in found if c.last < since]
            if len(older) > 1:
                older.sort(key=lambda c: (c.last, c.id), reverse=True)
            past = next((c for c in older if c.alike(r)), None)  # the newest
            events.opened(_event_id(r.document_id), r, past and past.id)


def _event_id(document: str) -> str:
    return hashlib.sha1(document.encode()).hexdigest()[:16]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, one run after the other. What is held are the clusters that a later row can meet: those of the merge
    window with their documents, those of the history without. Equal rows are one document. A row that is a run is
    an event, which no test comes to."""
    fold, seen, steps = _Fold(), 0, 0
    for batch in batches:
        done: list[tuple] = []
        news, *columns = (_values(batch.column(c)) for c in ("__new", *_Document.FIELDS))
        for new, ends, values in zip(news, [*news[1:], False], zip(*columns, strict=True), strict=True):
            if new:
                done += fold.events.rest()
                fold = _Fold()
                if ends:  # of the last row of a batch it isn't known
                    done.append((values[1], _event_id(values[1]), None))
                    continue
            r = _Document(*values)
            if not new and r.t > seen:
                steps += 1
                if steps % 256 == 0:
                    done += fold.events.settled(r.t - MERGE_SECONDS)
                if steps % 4096 == 0:
                    fold.events.forget(r.t - HISTORY_SECONDS)
            seen = r.t
            fold.take(r)
        yield _result(done)
    yield _result(fold.events.rest())


def _refolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with known events, one block after the other; a block is all that is held."""
    run: list[_Document] = []

    def folded() -> list[tuple]:
        fold = _Fold(run)
        for r in run:
            fold.take(r)
        return fold.events.rest()

    for batch in batches:
        done: list[tuple] = []
        columns = [_values(batch.column(c)) for c in ("__new", *_Document.FIELDS)]
        for new, *values in zip(*columns, strict=True):
            if new and run:
                done += folded()
                run.clear()
            run.append(_Document(*values))
        yield _result(done)
    yield _result(folded())


def _values(column: pa.Array) -> list:
    """What to_pylist gives, with null lists as empty ones: through numpy, and lists from one flat array."""
    if column.null_count == len(column):
        return [[]] * len(column) if pa.types.is_list(column.type) else [None] * len(column)
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).tolist() if not pa.types.is_integer(column.type) or not column.null_count else column.to_pylist()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    if not ends[-1]:
        return [[]] * len(ends)
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _result(rows: list[tuple]) -> pa.RecordBatch:
    names = ("document_id", "event_id", "historical_event_id")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=names)


def _placed(rows: DataFrame, unique: bool = False) -> DataFrame:
    """rows with their block: documents that share codes, directly or through others; those without codes alone."""
    return in_blocks(rows, "document_id", "codes", unique)


def _prepared(documents: DataFrame) -> DataFrame:
    rows = features(documents).withColumn("t", F.coalesce(F.unix_seconds(F.col("at").cast("timestamp")), F.lit(0).cast("long")))
    return rows.withColumn("codes", F.coalesce(F.array_compact("codes"), F.array().cast("array<string>")))


def _clustered(placed: DataFrame, known: bool = False, whole: bool = False) -> DataFrame:
    """whole: all documents at once, so that blocks are spread over the tasks of a shuffle; for a batch AQE says how many."""
    kept = placed.select("block", *_Document.FIELDS)
    kept = spread(kept, "block") if whole else kept
    runs = in_runs(kept, ["block"], F.col("t"), [F.asc("t"), F.asc("document_id")], None if known else HISTORY_SECONDS)
    return runs.mapInArrow(_refolded if known else _folded, "document_id string, event_id string, historical_event_id string")


def cluster_documents(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(document_id, event_id, historical_event_id) for rows of (document_id, at, title, body, url, content_hash,
    kind_hint, codes). known: (document_id, event_id) of earlier runs; running again over the same rows changes nothing.
    A document without codes is an event of its own. Blocks are cut where no document comes for longer than the history
    reaches; a run between two cuts is read once in order of time, and what is held are the clusters that a later
    document can still join or resemble. With known events a block is held whole, as they may be of any time.
    """
    rows = _prepared(documents)
    rows = rows.join(known.select("document_id", "event_id"), "document_id", "left") if known is not None else rows.withColumn("event_id", F.lit(None).cast("string"))
    return _clustered(_placed(rows), known is not None, whole=True)


RESULT = ["document_id", "event_id", "historical_event_id"]


def add_documents(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """stored with the documents of a batch: the rows of both, their block and the columns of cluster_documents.

    stored is what this gave for the batches before; None at first. Only blocks that a document of the batch shares a
    code with are folded again, joined into one where it ties them; the rows of all others are left as they are, in the
    column refolded. So batches in any order give what one run over all documents gives. Documents that are stored
    already are left alone.
    """
    new = batch.select("document_id", "at", "title", "body", "url", "content_hash", "kind_hint", "codes").dropDuplicates(["document_id"])
    if stored is None:
        rows = _prepared(new).withColumn("event_id", F.lit(None).cast("string"))
        placed = cut(_placed(rows, unique=True))
        return _with_results(placed, _clustered(placed))
    new = new.join(stored.select("document_id"), "document_id", "left_anti")
    fresh = cut(_prepared(new).withColumn("event_id", F.lit(None).cast("string")))
    asked = fresh.select(F.explode("codes").alias("code")).distinct()
    # a block stands in the graph as one document: its own name is its smallest code
    touched = stored.select("block", F.explode("codes").alias("code")).join(asked, "code").select("block", "code").distinct()
    as_document = F.concat(F.lit("block:"), "block")
    edges = touched.select(as_document.alias("article"), "code").union(touched.select(as_document, F.col("block"))).distinct()
    edges = edges.union(fresh.select(F.concat(F.lit("new:"), "document_id"), F.explode("codes")))
    blocks = cut(_blocks(edges))
    named = lambda kind, name: blocks.where(F.col("article").startswith(kind)).select(F.substring("article", len(kind) + 1, 1 << 30).alias(name), F.col("block").alias("new_block"))
    mine = stored.drop("refolded").join(named("block:", "block"), "block", "left")
    old = mine.where("new_block is not null").drop("block", *RESULT[1:]).withColumnRenamed("new_block", "block").withColumn("event_id", F.lit(None).cast("string"))
    own = fresh.join(named("new:", "document_id"), "document_id", "left").withColumn("block", F.coalesce("new_block", F.concat(F.lit("#"), "document_id"))).drop("new_block")
    placed = cut(own.unionByName(old))
    kept = mine.where("new_block is null").drop("new_block").withColumn("refolded", F.lit(False))
    return kept.unionByName(_with_results(placed, _clustered(placed)))


def _with_results(placed: DataFrame, clustered: DataFrame) -> DataFrame:
    return placed.drop("event_id").join(clustered, "document_id").withColumn("refolded", F.lit(True))
