"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, cut, slices, text_or_empty, word_bounds, word_hashes

#: Weight of the pooled covariance and of the scaled unit matrix in each class's covariance.
SHRINK_POOLED, SHRINK_UNIT = 0.2, 0.02
#: A row counts as good from this score on.
THRESHOLD = 0.3
#: Log densities differ by at most this before they become a score, so far-off texts don't overflow.
MOST_LOGIT = 60.0


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars.encode("latin-1"))] = 1
    return table


def _continuation() -> np.ndarray:
    table = np.ones(256, np.int64)
    table[0x80:0xC0] = 0
    return table


#: One table for each kind of byte that is counted: characters, then kinds whose share of the characters is a feature.
KINDS = {
    "chars": _continuation(),
    "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digit": _class("0123456789"),
    "stop": _class(".,;:?"),
    "mark": _class("!"),
    "bar": _class("|"),
    "symbol": _class("#$%&*@^~=+<>{}[]\\_/"),
    "line": _class("\n"),
}
FEATURES = ["log_chars", "log_words", "word_length", "distinct", "repeat", *(f"{k}_share" for k in KINDS if k != "chars")]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text. Shares get an arcsine root, counts a logarithm; empty texts get zeros."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets, SPACE)
    words = np.diff(first).astype(float)

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return np.diff(total[offsets]).astype(float)

    counts = {k: per_text(table[data]) for k, table in KINDS.items()}
    chars, some = np.maximum(counts["chars"], 1), np.maximum(words, 1)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    length = np.diff(size[first]) / some
    text = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    bits = np.uint64(max(1, int(n).bit_length()))
    tagged = np.sort((text << (np.uint64(64) - bits)) | (word_hashes(LOWER[data], starts, ends) >> bits))
    new = np.ones(len(tagged), bool)
    new[1:] = tagged[1:] != tagged[:-1]
    owner = (tagged >> (np.uint64(64) - bits)).astype(np.int64)
    distinct = np.bincount(owner[new], minlength=n)[:n]
    runs = np.flatnonzero(new)
    most = np.zeros(n)
    if len(runs):
        np.maximum.at(most, owner[runs], np.diff(np.concatenate([runs, [len(tagged)]])))
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / of, 0, 1)))
    return np.stack([np.log1p(counts["chars"]), np.log1p(words), np.log1p(length), share(distinct, some), share(most, some), *(share(counts[k], chars) for k in KINDS if k != "chars")], axis=1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the transformed statistics of every whole text; null texts count as empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                x = statistics(data, offsets)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(make, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))]))


def forward(factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """z of factor @ z = y for a lower triangular factor, one feature after the other for all columns of y."""
    z = np.empty_like(y)
    for i in range(len(factor)):
        z[i] = (y[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class Discriminant:
    """Per class: log prior, mean, and the Cholesky factor of its shrunken covariance with its log determinant."""

    log_prior: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]
    log_det: list[float]

    @classmethod
    def fit(cls, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float = SHRINK_POOLED, unit: float = SHRINK_UNIT) -> Discriminant | None:
        """moments: class to count, sum and sum of outer products. None unless both classes occur."""
        if any(moments.get(k, (0,))[0] < 1 for k in (0, 1)):
            return None
        total = sum(moments[k][0] for k in (0, 1))
        means = [moments[k][1] / moments[k][0] for k in (0, 1)]
        own = [moments[k][2] / moments[k][0] - np.outer(means[k], means[k]) for k in (0, 1)]
        both = sum(moments[k][0] * own[k] for k in (0, 1)) / total
        factors = []
        for c in own:
            c = (1 - pooled) * c + pooled * both
            factors.append(np.linalg.cholesky((1 - unit) * c + (unit * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))))
        return cls([float(np.log(moments[k][0] / total)) for k in (0, 1)], means, factors, [2 * float(np.log(np.diag(f)).sum()) for f in factors])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        log = []
        for k in (0, 1):
            z = forward(self.factor[k], (x - self.mean[k]).T)
            log.append(self.log_prior[k] - 0.5 * (self.log_det[k] + (z * z).sum(axis=0)))
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -MOST_LOGIT, MOST_LOGIT)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    for k, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["y", "i", "v"])


def fit(labelled: DataFrame) -> Discriminant | None:
    """The discriminant of (y, x) rows. Each task sends its two classes' moments, so the size is that of the features alone."""
    sums = labelled.select(F.col("y").cast("int").alias("y"), "x").where("y in (0, 1)").mapInArrow(_moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    d, found = len(FEATURES), {}
    for k in (0, 1):
        found[k] = np.zeros(1 + d + d * d)
    for row in sums.collect():  # 2 classes times the moments
        found[row.y][row.i] = row.v
    return Discriminant.fit({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in found.items()})


def score(stats: DataFrame, model: Discriminant | None) -> DataFrame:
    """(id, score) of (id, x) rows. Without a model every score is 1, so nothing is rejected unjudged."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x) if model else np.ones(len(x)))], ["id", "score"])

    return stats.mapInArrow(make, T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())]))


def held_out(id_col: str) -> F.Column:
    """True for the ids (as text) whose CRC-32 is a multiple of 5; those labels are never learned from. Null: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | None:
    """Fit on all labelled rows that are not held out. Of several labels of one id the smallest counts; null ids and labels don't."""
    known = labels.where(~held_out(id_col)).where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    return fit(stats.join(known.where("y is not null"), "id").select("y", "x"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of docs.

    The score is the discriminant's probability of label 1, from the text alone. Null texts count as empty and get a
    score; repeated rows are each scored; an empty table gives an empty table. If one of the classes has no label to
    learn from, every score is 1. Only the id and the text are read, so other columns can't clash.
    """
    stats = cut(document_statistics(docs, id_col, text_col))
    scored = score(stats, learn(stats, labels, id_col, label_col)).withColumnRenamed("id", id_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs whose score is at least THRESHOLD, with their columns as they are."""
    model = learn(document_statistics(docs, id_col, text_col), labels, id_col, label_col)
    names = docs.schema.names
    at = names.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for part, data, offsets in slices(named, str(at)):
                good = model.scores(statistics(data, offsets)) >= THRESHOLD
                yield part.filter(pa.array(good)).rename_columns(names)

    return docs if model is None else docs.mapInArrow(keep, docs.schema)
