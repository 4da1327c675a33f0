"""Quality classifier: regularised quadratic discriminant over document statistics.

Class covariances of the transformed statistics are shrunk towards the pooled covariance and then
towards a scaled identity.  Their Cholesky factors are computed once and travel with the model, so a
score is the difference of two Mahalanobis log densities plus the log prior odds, through the logistic
function.  Class sums, counts and cross products are gathered in one distributed aggregation over all
learning rows: there is no sample.

Nulls: a null text is an empty one.  Labels other than 0 and 1 are ignored; without rows of both
classes every document gets the smoothed share of class 1 (one half without any label).  Repeated
rows are scored alike, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import bounded, slices, texts
from cpgloom.session import materialize

# Weight of the pooled covariance, and then of the scaled identity.
POOLED, SPHERE = 0.1, 0.02

_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#$%&*@^~+=_",
    "frame": b"|<>{}[]\\/",
}
STATISTICS = [*_BYTES, "word_repeat", "pair_repeat", "word_length", "short_word"]
# A share is smoothed as if this many bytes or words of ordinary prose had been seen besides,
# so that short texts stay near the usual values.
_BYTES_BEFORE, _WORDS_BEFORE = 400.0, 80.0
_USUAL = {"upper": 0.02, "digit": 0.001, "stop": 0.015, "shout": 0.0, "symbol": 0.0, "frame": 0.0}
_USUAL |= {"word_repeat": 0.005, "pair_repeat": 0.02, "word_length": 5.5, "short_word": 0.3}


def _statistics(rows: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text."""
    out = np.empty((len(rows), len(STATISTICS)))
    sets = [np.frombuffer(s, np.uint8) for s in _BYTES.values()]
    raw = np.empty((len(rows), len(sets)))
    size, words_n = np.empty(len(rows)), np.empty((len(rows), 5))
    for i, text in enumerate(rows):
        seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        raw[i] = [seen[s].sum() for s in sets]
        size[i] = len(text)
        words = text.split()
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int32, n)
        pairs = n - 1 - len(set(zip(words, words[1:], strict=False))) if n > 1 else 0
        words_n[i] = n, sum(map(eq, words, words[1:])), pairs, lengths.sum(), (lengths <= 3).sum()
    usual = np.array([_USUAL[k] for k in STATISTICS])
    out[:, : len(sets)] = (raw + _BYTES_BEFORE * usual[: len(sets)]) / (size + _BYTES_BEFORE)[:, None]
    out[:, len(sets) :] = (words_n[:, 1:] + _WORDS_BEFORE * usual[len(sets) :]) / (words_n[:, :1] + _WORDS_BEFORE)
    length = STATISTICS.index("word_length")
    shares = [k for k in range(len(STATISTICS)) if k != length]
    out[:, shares] = np.arcsin(np.sqrt(np.clip(out[:, shares], 0, 1)))
    out[:, length] = np.log(out[:, length] + 1)
    return out


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the transformed statistics of the whole text (``stats``, an array of doubles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            x = _statistics(texts(b.column("t")))
            yield pa.record_batch([b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "stats"])

    return bounded(docs).select("doc_id", F.col(text).alias("t")).mapInArrow(work, "doc_id long, stats array<double>")


@dataclass
class Discriminant:
    """The fitted model; a handful of numbers for each class."""

    prior: float
    means: np.ndarray | None = None  # class x statistic
    factors: np.ndarray | None = None  # inverse Cholesky factors, class x statistic x statistic
    log_dets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = np.einsum("kij,nkj->nki", self.factors, x[:, None, :] - self.means)
        density = -0.5 * ((z**2).sum(2) + self.log_dets)
        odds = density[:, 1] - density[:, 0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def discriminant(count: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float, sphere: float) -> Discriminant:
    """Model from the class counts, sums and cross products."""
    prior = float((count[1] + 1) / (count.sum() + 2))
    if min(count) < 2:
        return Discriminant(prior)
    means = sums / count[:, None]
    scatter = products - count[:, None, None] * means[:, :, None] * means[:, None, :]
    joint = scatter.sum(0) / (count.sum() - 2)
    scale = np.sqrt(np.maximum(np.diag(joint), 1e-12))
    factors, dets = [], []
    for k in range(2):
        cov = ((1 - pooled) * scatter[k] / (count[k] - 1) + pooled * joint) / np.outer(scale, scale)
        cov = (1 - sphere) * cov + sphere * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-9 * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low) / scale[None, :])
        dets.append(2 * np.log(np.diag(low)).sum() + 2 * np.log(scale).sum())
    return Discriminant(prior, means, np.array(factors), np.array(dets))


def fit(stats: DataFrame, labels: DataFrame, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant:
    """Learn from ``stats`` (doc_id, stats) and ``labels`` (doc_id, quality); every labelled row counts."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for b in batches:
            y = b.column("quality").to_numpy(zero_copy_only=False)
            x = np.ones((len(y), d + 1))
            x[:, 1:] = np.array(b.column("stats").to_pylist()).reshape(len(y), d)
            for k in range(2):
                total[k] += x[y == k].T @ x[y == k]
        k, i, j = np.indices(total.shape).reshape(3, -1).astype(np.int32)
        yield pa.record_batch([k, i, j, total.ravel()], ["k", "i", "j", "v"])

    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = (
        stats.join(known, "doc_id")
        .select("quality", "stats")
        .mapInArrow(sums, "k int, i int, j int, v double")
        .groupBy("k", "i", "j")
        .agg(F.sum("v").alias("v"))
        .collect()  # two small square matrices
    )
    total = np.zeros((2, d + 1, d + 1))
    for r in rows:
        total[r.k, r.i, r.j] = r.v
    return discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:], pooled, sphere)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that learning never sees: a third by checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: class 1 likelier) and ``predicted`` of every document."""
    stats = materialize(statistics(docs, text), "stats")
    model = fit(stats, labels.where(~held_out()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("stats").to_pylist()).reshape(b.num_rows, len(STATISTICS))
                yield pa.record_batch([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(work, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose score reaches ``least``, with all their columns."""
    model = fit(materialize(statistics(docs, text), "stats"), labels.where(~held_out()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield b.filter(pa.array(model.score(_statistics(texts(b.column(text)))) >= least))

    return bounded(docs).mapInArrow(work, docs.schema)
