"""Principal components of wide or tall tables, by block iteration from a random start.

A table has one row per line of the matrix: (id, x ARRAY<DOUBLE>), all arrays of one length.  The number of rows
is free; the length may be whatever lets ``length x block`` doubles fit in ``MAX_BLOCK`` (checked).  The side
that may grow without bound, probes or samples, goes into the rows:

* ``of_cells``: few samples, any number of probes.  Rows are probes, centred over the samples.
* ``of_rows``: few features, any number of samples.  Rows are samples, centred by the feature means.

Each turn is one pass over the table.  A task multiplies its rows with the block and their transpose with the
result, so that only ``length x block`` sums leave it; these are added up on the cluster.  The turn ends with
Rayleigh quotients and their residuals, and the iteration stops when every wanted component has settled to ``tol``
times the largest eigenvalue.  The last pass takes the tall product by a QR tree (tasks, then groups of
``FAN`` factors), so small singular values keep their digits: they never come from squared sums.

A table without spread has no components; components beyond the rank are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators import sample_space as ss
from cpgloom.operators.gram import MAX_FEATURES
from cpgloom.operators.sample_space import SampleSpace
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

# Bytes of one block of vectors, in each task and on the driver.
MAX_BLOCK = 256 << 20
# Vectors beyond the wanted ones; they speed up the last of these.
EXTRA = 20
# A block is at least so wide, where it fits: more vectors take fewer passes, and all of them take one.
WIDE = 1024
# Samples in a list of cells, and bytes of sums that a task holds before it hands them on.
LIST, FLUSH = 256, 64 << 20
# Triangular factors that meet in one task of the QR tree.
FAN = 8
# Singular values below this share of the largest are rounding.
RANK_TOL = 1e-10


@dataclass
class Components:
    """``vectors`` (length x k, orthonormal), singular ``values`` (falling), ``total`` sum of squares of the centred
    table, and ``gap``, the largest residual as a share of the first eigenvalue."""

    vectors: np.ndarray
    values: np.ndarray
    total: float
    gap: float
    turns: int

    @property
    def share(self) -> np.ndarray:
        return self.values**2 / self.total if self.total else self.values


def _blocks(batches: Iterator[pa.RecordBatch], length: int, centre: np.ndarray | None, column: str = "x") -> Iterator[np.ndarray]:
    """Rows of a task in blocks, centred by ``centre``, or each by its own mean where that is None."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            x = batch.slice(i, 4096).column(column)
            if x.null_count or x.flatten().null_count:
                raise ValueError("the table has missing values: impute first")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            yield x - (x.mean(1, keepdims=True) if centre is None else centre)


def _summed(rows: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over tasks of a matrix each task makes, added up row by row on the cluster."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(batches)
        for i in range(0, len(total), 256):
            part = total[i : i + 256]
            yield pa.record_batch([pa.array(range(i, i + len(part)), pa.int32()), pa.array(list(part), pa.list_(pa.float64()))], ["i", "row"])

    parts = rows.mapInArrow(work, "i INT, row ARRAY<DOUBLE>")
    out = np.zeros(shape)
    for r in parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row")).toLocalIterator():
        out[r["i"]] = r["row"].toArray()
    return out


def tall_r(rows: DataFrame, length: int, block: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """The triangular factor of (centred rows) @ ``block``: QR in every task, then of ``FAN`` factors at a time."""
    width = block.shape[1]

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for x in _blocks(batches, length, centre):
            r = np.linalg.qr(np.vstack([r, x @ block]), mode="r")
        if len(r):
            names, at = ["block", "i", "row"], TaskContext.get().partitionId()
            yield pa.record_batch([pa.array([at] * len(r), pa.int32()), pa.array(range(len(r)), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], names)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "i"])
        r = np.linalg.qr(np.vstack(pdf["row"].to_numpy()), mode="r")
        return pd.DataFrame({"block": pdf["block"].iloc[0] // FAN, "i": np.arange(len(r)), "row": list(r)})

    schema = "block INT, i INT, row ARRAY<DOUBLE>"
    parts = materialize(rows.select("x").mapInArrow(leaf, schema), "factors")
    last = parts.agg(F.max("block")).first()[0]
    while last:
        parts = parts.groupBy(F.expr(f"block div {FAN}")).applyInPandas(join, schema)
        last //= FAN
    found = {r["i"]: r["row"] for r in parts.collect()}  # at most ``width`` rows
    return np.array([found[i] for i in sorted(found)]).reshape(-1, width)


def principal(
    rows: DataFrame,
    length: int,
    k: int,
    centre: np.ndarray | None = None,
    wide: int = WIDE,
    turns: int = 60,
    tol: float = 1e-10,
    seed: int = 42,
) -> Components:
    """The first ``k`` right singular vectors and values of ``rows`` (a stored table with column x)."""
    need = k + max(EXTRA, k // 4)
    width = min(length, max(need, min(wide, MAX_BLOCK // (8 * max(length, 1)))))
    if length * width * 8 > MAX_BLOCK:
        raise ValueError(f"{width} vectors of {length} entries exceed {MAX_BLOCK >> 20} MB: put the longer side into the rows or ask for fewer")
    rows = rows.select("x")
    z = np.linalg.qr(np.random.default_rng(seed).standard_normal((length, width)))[0]
    total, gap, done = 0.0, np.inf, 0
    for _ in range(turns):

        def turn(batches: Iterator[pa.RecordBatch], z: np.ndarray = z) -> np.ndarray:
            w = np.zeros((length + 1, width))  # the last row carries the sum of squares
            for x in _blocks(batches, length, centre):
                w[:-1] += x.T @ (x @ z)
                w[-1, 0] += np.einsum("ij,ij->", x, x)
            return w

        w = _summed(rows, turn, (length + 1, width))
        total, w, done = float(w[-1, 0]), w[:-1], done + 1
        if total == 0:
            return Components(np.zeros((length, 0)), np.zeros(0), 0.0, 0.0, done)
        value, turned = np.linalg.eigh(z.T @ w)
        order = np.argsort(-value)[:k]
        rest = w @ turned[:, order] - (z @ turned[:, order]) * value[order]
        gap = float(np.linalg.norm(rest, axis=0).max() / value.max())
        if gap <= tol:
            break
        z = np.linalg.qr(w)[0]
    r = tall_r(rows, length, z, centre)
    _, s, right = np.linalg.svd(r)
    k = min(k, int((s > RANK_TOL * s[0]).sum()))
    vectors = z @ right[:k].T
    # Signs are free; the entry of largest size is made positive.
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return Components(vectors, s[:k], total, gap, done)


# --- few samples, any number of probes ------------------------------------------------------------


@dataclass
class CellComponents:
    """``axes``: stored (feature, mean, axis ARRAY of k); ``scores``: samples x k, in the order of ``samples``."""

    axes: DataFrame
    samples: list
    scores: np.ndarray
    found: Components


def of_cells(cells: DataFrame, samples: DataFrame, k: int, value: str = "z", feature: str = "feature", **told) -> CellComponents:
    """Components of complete long cells (sample_id, feature, value) over ``samples`` (sample_id, label)."""
    space = SampleSpace.from_cells(cells, samples, value, feature)
    return of_space(space, k, **told)


def of_space(space: SampleSpace, k: int, **told) -> CellComponents:
    n = len(space.samples)
    found = principal(space.columns, n, k, **told)
    turn = found.vectors / found.values

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            mean = x.mean(1)
            axis = (x - mean[:, None]) @ turn
            yield pa.record_batch([batch.column("feature"), pa.array(mean), pa.array(list(axis), pa.list_(pa.float64()))], ["feature", "mean", "axis"])

    axes = space.columns.select("feature", "x").mapInArrow(work, "feature BIGINT, mean DOUBLE, axis ARRAY<DOUBLE>")
    return CellComponents(materialize(axes, "axes"), space.samples, found.vectors * found.values, found)


def of_design(rows: DataFrame, k: int | None) -> tuple[Components, DataFrame, Callable[[DataFrame], DataFrame]]:
    """Components (None: all) of ``rows`` (sample_id, label, features ARRAY) of any number of samples: what was found, the
    axes (feature, mean, axis) and a function from such rows to their scores (sample_id, pc ARRAY).

    Over ``sample_space.MAX_SAMPLES`` samples the samples are the rows, and one pass takes all features.
    """
    n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    if n <= ss.MAX_SAMPLES:
        made = of_space(SampleSpace.from_rows(rows), k or n)
        return made.found, made.axes, lambda asked: project_cells(asked.select("sample_id", F.posexplode("features").alias("feature", "z")), made.axes)
    if width > MAX_FEATURES:
        raise ValueError(f"more than {ss.MAX_SAMPLES} samples of more than {MAX_FEATURES} features: choose features first")
    stored = rows.select("sample_id", array_to_vector("features").alias("features"))
    found, mean = of_rows(stored, min(k or width, width), wide=width)
    table = [(i, float(m), a) for i, (m, a) in enumerate(zip(mean, found.vectors.tolist(), strict=True))]
    axes = rows.sparkSession.createDataFrame(table, "feature BIGINT, mean DOUBLE, axis ARRAY<DOUBLE>")  # a row a feature

    def scores(asked: DataFrame) -> DataFrame:
        return project_rows(asked.select("sample_id", array_to_vector("features").alias("features")), found, mean).select("sample_id", "pc")

    return found, materialize(axes, "axes"), scores


def project_cells(cells: DataFrame, axes: DataFrame, value: str = "z", feature: str = "feature") -> DataFrame:
    """Scores of any samples on fitted axes: (sample_id, pc ARRAY).  Features without an axis do not count, and a
    missing value counts as the feature's mean."""
    slim = cells.select("sample_id", F.col(feature).cast("long").alias("feature"), F.col(value).cast("double").alias("z"))
    # A feature's cells come in lists of some ``LIST`` samples, so that an axis meets many cells at once.
    n = slim.agg(F.approx_count_distinct("sample_id")).first()[0]
    part = F.pmod(F.xxhash64("sample_id"), F.lit(max(1, n // LIST))).alias("part")
    lists = slim.groupBy("feature", part).agg(F.collect_list(F.struct("sample_id", F.coalesce("z", F.lit(float("nan"))).alias("z"))).alias("cells"))
    met = lists.join(sized(axes), "feature").select("cells", "mean", "axis")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = {}, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = batch.slice(i, 64)
                flat, size = rows.column("cells").flatten(), rows.column("cells").value_lengths().to_numpy()
                axis = rows.column("axis").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
                at = np.repeat(np.arange(rows.num_rows), size)
                coded = flat.field("sample_id").dictionary_encode()
                ids = coded.dictionary.to_pylist()
                z = flat.field("z").to_numpy() - rows.column("mean").to_numpy()[at]
                shift = np.zeros((len(ids), rows.num_rows))
                np.add.at(shift, (coded.indices.to_numpy(), at), np.where(np.isnan(z), 0.0, z))
                if total is None:
                    total = np.zeros((0, axis.shape[1]))
                to = np.array([place.setdefault(x, len(place)) for x in ids])
                if len(place) > len(total):
                    total = np.vstack([total, np.zeros((max(len(place) - len(total), len(total)), axis.shape[1]))])
                total[to] += shift @ axis
                if total.nbytes > FLUSH:
                    yield from _labelled(place, total)
                    place, total = {}, None
        if place:
            yield from _labelled(place, total)

    parts = met.mapInArrow(work, "sample_id STRING, p ARRAY<DOUBLE>")
    return parts.groupBy("sample_id").agg(vector_to_array(Summarizer.sum(array_to_vector("p"))).alias("pc"))


def _labelled(place: dict, total: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids = list(place)
    for i in range(0, len(ids), 1024):
        part = total[i : min(i + 1024, len(ids))]
        yield pa.record_batch([pa.array(ids[i : i + 1024], pa.string()), pa.array(list(part), pa.list_(pa.float64()))], ["sample_id", "p"])


# --- few features, any number of samples ----------------------------------------------------------


def of_rows(rows: DataFrame, k: int, features: str = "features", **told) -> tuple[Components, np.ndarray]:
    """Components and feature means of a vector column; ``project_rows`` gives the scores."""
    stored = materialize(rows.select(vector_to_array(F.col(features)).alias("x")), "rows")
    if stored.isEmpty():
        return Components(np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0), np.zeros(0)
    centre = stored.select(Summarizer.mean(array_to_vector("x"))).first()[0].toArray()
    return principal(stored, len(centre), k, centre=centre, **told), centre


def project_rows(rows: DataFrame, found: Components, mean: Sequence[float], features: str = "features") -> DataFrame:
    """``rows`` with their scores ``pc``."""
    vectors, mean, columns = found.vectors, np.asarray(mean), [c for c in rows.columns if c != "pc"]
    flat = rows.select(*columns, vector_to_array(F.col(features)).alias("_x"))

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.vstack(x.to_numpy()) - mean) @ vectors) if len(x) else [])

    return flat.withColumn("pc", scores("_x")).drop("_x")
