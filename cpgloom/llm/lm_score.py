"""LM scoring by cross-entropy difference.

Two n-gram models over the same vocabulary, the 256 bytes of UTF-8, are trained alike: the target model on
chosen rows, the background model on all of them.  Counts of byte trigrams cover whole texts of all rows:
tasks add up their share, Spark sums by trigram.  Both models interpolate trigrams, bigrams, single
bytes and the uniform distribution by the method of Witten and Bell.  The loss of a token is minus the log
of its probability; a document's score is the mean over its tokens of target loss minus background loss,
so a low score means text like the target.  The difference of all trigrams is one table of 256^3 32-bit numbers,
whatever the size of the corpus; that is the bound of what goes to the driver and the tasks.

A text's first two tokens have two bytes of zero before them, so each byte is one token.  Nulls: a null or
empty text has no tokens and null losses.  Without target rows both models are the background model.
Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.llm.common import bounded, slices, utf8

CELLS = 1 << 24


def _tokens(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Trigram number of every byte; a text starts after two zeros."""
    byte = data.astype(np.int32)
    before, before2 = np.zeros_like(byte), np.zeros_like(byte)
    before[1:], before2[2:] = byte[:-1], byte[:-2]
    first = bounds[:-1][np.diff(bounds) > 0]
    before[first] = before2[first] = 0
    second = first[first + 1 < len(byte)] + 1
    before2[second] = 0
    return before2 << 16 | before << 8 | byte


def counts(rows: DataFrame) -> DataFrame:
    """``cell`` (trigram), ``n`` (all rows) and ``n_target`` of ``rows`` (t, target)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(0, np.int32), np.zeros((2, 0), np.int64)
        for batch in slices(batches, "t"):
            data, bounds = utf8(batch.column("t"))
            cell = _tokens(data, bounds)
            mine = np.repeat(batch.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
            for kind, some in enumerate((cell, cell[mine])):
                at, k = np.unique(some, return_counts=True)
                both, where = np.unique(np.concatenate([cells, at]), return_inverse=True)
                total = np.zeros((2, len(both)), np.int64)
                total[:, where[: len(cells)]] = n
                total[kind, where[len(cells) :]] += k
                cells, n = both, total
        yield pa.record_batch([cells, *n], ["cell", "n", "n_target"])

    parts = bounded(rows).mapInArrow(work, "cell int, n long, n_target long")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def _step(level: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of the next longer context; an unseen one leaves all to the shorter."""
    kinds, seen = (level > 0).sum(-1, keepdims=True), level.sum(-1, keepdims=True)
    return np.where(seen > 0, (level + kinds * lower) / np.maximum(seen + kinds, 1), lower)


def losses(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Minus log probability (natural) of every trigram's last byte, from the sorted trigrams and their counts."""
    pair = np.bincount(cells & 0xFFFF, n, 1 << 16).reshape(256, 256)
    lower = _step(pair, _step(pair.sum(0), np.full(256, 1 / 256)))
    out = np.empty(CELLS, np.float32)
    cuts = np.searchsorted(cells, np.arange(257) << 16)
    for first in range(256):  # a slice of contexts at a time, to save memory
        some = slice(cuts[first], cuts[first + 1])
        level = np.bincount(cells[some] & 0xFFFF, n[some], 1 << 16).reshape(256, 256)
        out[first << 16 : (first + 1) << 16] = -np.log(_step(level, lower)).ravel()
    return out


def models(docs: DataFrame, target: Column, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Losses of the target and the background model, each a table of 256^3."""
    rows = docs.select(F.col(text).alias("t"), F.coalesce(target, F.lit(False)).alias("target"))
    found = counts(rows).toPandas().sort_values("cell")  # at most 256^3 rows
    cells, every, chosen = (found[c].to_numpy(np.int64) for c in ("cell", "n", "n_target"))
    return losses(cells, chosen if chosen.any() else every), losses(cells, every)


def score(docs: DataFrame, target: Column, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, mean ``target_loss`` and ``background_loss`` and their difference ``score``."""
    spark = docs.sparkSession
    tables = [spark.sparkContext.broadcast(t) for t in models(docs, target, text)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            data, bounds = utf8(batch.column("t"))
            cell, n = _tokens(data, bounds), np.diff(bounds)
            sums = [np.diff(np.concatenate([[0.0], np.cumsum(t.value[cell], dtype=np.float64)])[bounds]) for t in tables]
            mean = [pa.array(s / np.maximum(n, 1), mask=n == 0) for s in sums]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n), *mean], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    rows = bounded(docs).select("doc_id", F.col(text).alias("t"))
    out = rows.mapInArrow(work, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
