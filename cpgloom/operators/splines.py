"""Additive models of penalised splines, smoothed by generalised cross-validation.

Every feature gets cubic B-splines on equal segments between its smallest and largest training value, and
a penalty on the second differences of neighbouring coefficients, so a strong penalty leaves a straight
line and not a constant.  One pass over the training rows sums the cross products of all basis columns
and the label; every strength of the grid is then solved and judged from these sums alone.  What reaches
the driver has the size columns x columns (features x splines, checked), whatever the number of samples.

A fitted curve is a cubic polynomial on each segment.  Predictions look the segment up and sum the
polynomials with SQL functions; beyond the training range a curve goes on along its tangent.

Nulls: a row with a null label or a null or non-finite feature takes no part in the fit and is predicted as null.
A feature that is constant on the training rows gets a flat curve.  No usable row at all is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.gram import MAX_FEATURES, centred, fold_grams
from cpgloom.operators.saved import Saved

SEGMENTS = 17
# Strengths tried: eleven from 0.001 to 1000, evenly spaced in the logarithm.
STRENGTHS = tuple(float(x) for x in np.logspace(-3, 3, 11))
# What an effective degree of freedom costs in the criterion; above one it guards against rough curves.
COST = 1.4
# The four cubics of a segment, from the spline that ends there to the one that starts there; powers 0 to 3.
PIECES = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]], float) / 6.0


@dataclass
class Trial:
    """One strength: effective degrees of freedom, residual sum of squares, criterion, coefficients."""

    strength: float
    edf: float
    rss: float
    gcv: float
    coef: np.ndarray


def basis(x: np.ndarray, low: np.ndarray, step: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Basis columns (rows, features * (segments + 3)) of values within the training range."""
    n, k = x.shape
    place = np.clip((x - low) / step, 0.0, segments)
    seg = np.minimum(place.astype(int), segments - 1)
    powers = (place - seg)[..., None] ** np.arange(4)
    out = np.zeros((n, k, segments + 3))
    i, j = np.indices((n, k))
    for p in range(4):
        out[i, j, seg + p] = powers @ PIECES[p]
    return out.reshape(n, -1)


def penalty(features: int, segments: int = SEGMENTS) -> np.ndarray:
    """Squared second differences of the coefficients, feature by feature."""
    d = np.diff(np.eye(segments + 3), 2, axis=0)
    return np.kron(np.eye(features), d.T @ d)


def level(features: int, segments: int = SEGMENTS) -> np.ndarray:
    """Fixes each curve's level, which the intercept holds already; it changes no fitted value."""
    q = segments + 3
    return np.kron(np.eye(features), np.full((q, q), 1.0 / q))


def usable(df: DataFrame, label: str | None = None) -> Column:
    """Rows whose features (and label) are all finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    fine = F.coalesce(F.forall(vector_to_array("features"), finite), F.lit(False))
    return fine if label is None else fine & finite(F.col(label).cast("double"))


def trials(gram: np.ndarray, features: int, segments: int, strengths: Sequence[float], cost: float = COST) -> list[Trial]:
    """Every strength solved from Z'Z of Z = [1, basis columns, label]."""
    n, _, c = centred(gram)
    c, b, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    smooth, fixed, out = penalty(features, segments), level(features, segments), []
    for strength in strengths:
        # Features that depend on each other linearly leave a singular system; the shortest solution is taken.
        inverse = np.linalg.pinv(c + strength * smooth + fixed, rcond=1e-12, hermitian=True)
        w = inverse @ b
        edf = 1.0 + float(np.sum(inverse * c))
        rss = max(float(yy - 2 * b @ w + w @ c @ w), 0.0)
        free = n - cost * edf
        out.append(Trial(strength, edf, rss, n * rss / free**2 if free > 0 else float("inf"), w))
    return out


class PenalisedSplines(Estimator, Saved):
    """Additive cubic splines with one strength, chosen from ``strengths`` by generalised cross-validation.

    Ties go to the stronger penalty, and so does a design with fewer rows than any strength's degrees of freedom.
    """

    parts = ("segments", "strengths", "cost", "label")

    def __init__(self, segments: int = SEGMENTS, strengths: Sequence[float] = STRENGTHS, cost: float = COST, label: str = "label"):
        super().__init__()
        self.segments, self.strengths, self.cost, self.label = segments, list(strengths), cost, label

    def _fit(self, df: DataFrame) -> SplineCurves:
        rows = df.where(usable(df, self.label)).select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("y"))
        ends = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        ends = sorted(ends.limit(MAX_FEATURES + 1).collect(), key=lambda r: r["i"])  # one row per feature
        k, q, segments = len(ends), self.segments + 3, self.segments
        if not k:
            raise ValueError("no row has a label and finite features")
        if k * q > MAX_FEATURES:
            raise ValueError(f"{k} features of {q} splines exceed {MAX_FEATURES} basis columns; select first")
        low = np.array([r["low"] for r in ends])
        step = np.array([(r["high"] - r["low"]) / segments for r in ends])
        step[step == 0] = 1.0

        def columns(block: np.ndarray) -> np.ndarray:
            return np.hstack([basis(block[:, :-1], low, step, segments), block[:, -1:]])

        gram = fold_grams(rows.select(F.concat("x", F.array("y")).alias("v")), "v", prepare=columns)[0]
        found = trials(gram, k, segments, self.strengths, self.cost)
        best = min(found, key=lambda t: (t.gcv, -t.strength))
        mean = gram[0, 1:] / gram[0, 0]
        shift = float(mean[-1] - mean[:-1] @ best.coef)
        table = [[t.strength, t.edf, t.rss, t.gcv] for t in found]
        return SplineCurves(low.tolist(), step.tolist(), best.coef.reshape(k, q).tolist(), shift, best.strength, table)


class SplineCurves(Model, Saved):
    """Fitted curves; ``grid`` has strength, effective degrees of freedom, residual sum and criterion per trial."""

    parts = ("low", "step", "coef", "shift", "strength", "grid")

    def __init__(self, low: list, step: list, coef: list, shift: float, strength: float, grid: list):
        super().__init__()
        self.low, self.step, self.coef, self.shift, self.strength, self.grid = low, step, coef, shift, strength, grid

    @property
    def cubics(self) -> list[list[list[float]]]:
        """Polynomial coefficients by feature, segment and power of the place in the segment (0 to 1)."""
        w = np.array(self.coef)
        windows = np.stack([w[:, p : w.shape[1] - 3 + p] for p in range(4)], axis=-1)
        return (windows @ PIECES).tolist()

    def effects(self, features: Column) -> Column:
        """Array of each feature's curve value."""
        low, step, cubics = F.lit(self.low), F.lit(self.step), F.lit(self.cubics)
        last = len(self.coef[0]) - 4

        def curve(x: Column, i: Column) -> Column:
            place = (x - F.get(low, i)) / F.get(step, i)
            seg = F.greatest(F.least(F.floor(place), F.lit(last)), F.lit(0)).cast("int")
            c = F.get(F.get(cubics, i), seg)
            c0, c1, c2, c3 = (F.get(c, F.lit(p)) for p in range(4))
            # Within the range, then along the tangent at its end.
            at = F.greatest(F.least(place, F.lit(last + 1.0)), F.lit(0.0)) - seg
            return c0 + at * (c1 + at * (c2 + at * c3)) + (place - seg - at) * (c1 + at * (2 * c2 + 3 * at * c3))

        return F.transform(features, curve)

    def _transform(self, df: DataFrame) -> DataFrame:
        total = F.aggregate(self.effects(vector_to_array("features")), F.lit(float(self.shift)), lambda a, x: a + x)
        return df.withColumn("prediction", F.when(usable(df), total))

    def trials(self, df: DataFrame) -> DataFrame:
        """``(strength, edf, rss, gcv, chosen)``: the search as a table in the session of ``df``."""
        rows = [(*map(float, t), t[0] == self.strength) for t in self.grid]
        return df.sparkSession.createDataFrame(rows, "strength DOUBLE, edf DOUBLE, rss DOUBLE, gcv DOUBLE, chosen BOOLEAN")

    def gaps(self, df: DataFrame, label: str = "label") -> DataFrame:
        """``(feature, spline, gap)``: how far each coefficient is from optimal, summed anew over ``df``.

        The gradient is ``B'r - strength * P w``; the level term leaves it equal within a feature's constants.
        """
        k, q = len(self.coef), len(self.coef[0])
        w = np.array(self.coef).ravel()
        pull = ((self.strength * penalty(k, q - 3) + level(k, q - 3)) @ w).reshape(k, q).tolist()
        scored = self.transform(df.where(usable(df, label)))
        place = F.transform(vector_to_array("features"), lambda x, i: (x - F.get(F.lit(self.low), i)) / F.get(F.lit(self.step), i))
        cells = scored.select((F.col(label) - F.col("prediction")).alias("r"), F.posexplode(place).alias("feature", "place"))
        seg = F.greatest(F.least(F.floor("place"), F.lit(q - 4)), F.lit(0)).cast("int")
        u = F.col("place") - seg
        values = F.array(*[float(a) + u * (float(b) + u * (float(c) + u * float(d))) for a, b, c, d in PIECES])
        cells = cells.select("feature", "r", seg.alias("seg"), F.posexplode(values).alias("p", "value"))
        sums = cells.groupBy("feature", (F.col("seg") + F.col("p")).alias("spline")).agg(F.sum(F.col("value") * F.col("r")).alias("g"))
        spark = df.sparkSession
        wanted = spark.createDataFrame([(i, j, float(pull[i][j])) for i in range(k) for j in range(q)], "feature INT, spline INT, pull DOUBLE")
        both = wanted.join(sums, ["feature", "spline"], "left")
        # The intercept takes each basis column's mean off; residuals sum to zero, so nothing is left to subtract.
        return both.select("feature", "spline", F.abs(F.coalesce("g", F.lit(0.0)) - F.col("pull")).alias("gap"))
