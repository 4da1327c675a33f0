"""Linear models: single fits with Spark ML, searches over folds and penalties from one data pass.

Penalties are given in the usual per-sample form, ``1/(2n) |y - Xw|^2 + alpha (rho |w|_1 +
(1 - rho)/2 |w|^2)`` (ridge: ``|y - Xw|^2 + alpha |w|^2``).  Spark ML divides by the label's
standard deviation first, so the strengths are converted, not passed through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.gram import MAX_FEATURES, fold_grams


def spark_penalty(alpha: float, rho: float | None, n: int, label_sd: float) -> tuple[float, float]:
    """``(regParam, elasticNetParam)`` for an elastic net, or for ridge when ``rho`` is None."""
    if rho is None:
        return alpha / n * label_sd, 0.0
    l1, l2 = alpha * rho, alpha * (1.0 - rho) * label_sd
    total = l1 + l2
    return total, (l1 / total if total > 0 else 0.0)


# Spark's normal-equation solver accepts this many features; it reads the rows once.
NORMAL_SOLVER_WIDTH = 4096


class Penalised(Estimator):
    """Elastic net (``rho`` in [0, 1]) or ridge (``rho=None``) on vectors, solved by Spark ML.

    Up to 4096 features the normal solver is exact for ridge and needs one pass; it scales by the
    population sd of the label.  Wider designs go through L-BFGS passes, which use the sample sd.
    """

    def __init__(self, alpha: float, rho: float | None = None, label: str = "label", max_iter: int = 1000):
        super().__init__()
        self.alpha, self.rho, self.label, self.max_iter = alpha, rho, label, max_iter

    def _fit(self, df: DataFrame):
        s = df.agg(
            F.count("*").alias("n"),
            F.stddev_samp(self.label).alias("sample_sd"),
            F.stddev_pop(self.label).alias("pop_sd"),
            F.max(F.size(vector_to_array("features"))).alias("width"),
        ).first()
        narrow = (s["width"] or 0) <= NORMAL_SOLVER_WIDTH
        sd = s["pop_sd"] if narrow else s["sample_sd"]
        reg, mix = spark_penalty(self.alpha, self.rho, s["n"], sd or 1.0)
        lr = LinearRegression(
            labelCol=self.label, regParam=reg, elasticNetParam=mix, standardization=False,
            solver="normal" if narrow else "l-bfgs", maxIter=self.max_iter, tol=1e-9,
        )
        return lr.fit(df)


def ridge(alpha: float = 1.0, label: str = "label") -> Penalised:
    return Penalised(alpha, None, label)


def lasso(alpha: float = 1.0, label: str = "label") -> Penalised:
    return Penalised(alpha, 1.0, label)


def elastic_net(alpha: float = 1.0, rho: float = 0.5, label: str = "label") -> Penalised:
    return Penalised(alpha, rho, label)


def cross_validated(grid_alpha: Sequence[float], grid_mix: Sequence[float], fold_col: str = "fold", folds: int = 3, parallelism: int = 4):
    """Spark's own cross-validation of a linear model; for designs too wide for cross products."""
    lr = LinearRegression(standardization=False, solver="l-bfgs", maxIter=300)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(grid_alpha)).addGrid(lr.elasticNetParam, list(grid_mix)).build()
    return CrossValidator(
        estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(metricName="mae"),
        numFolds=folds, foldCol=fold_col, parallelism=parallelism,
    )


# --- searches from cross products ---------------------------------------------------------------


@dataclass
class LinearFit:
    coef: np.ndarray
    intercept: float
    alpha: float = 0.0
    rho: float | None = None

    def column(self, features: str = "features"):
        """Prediction over an array column: a Spark expression, or an Arrow batch product where that would be too long."""
        if len(self.coef) > MAX_FEATURES:
            coef, shift = self.coef, self.intercept

            @F.pandas_udf("double")
            def product(x: pd.Series) -> pd.Series:
                return pd.Series(np.vstack(x.to_numpy()) @ coef + shift if len(x) else [], dtype="float64")

            return product(F.col(features))
        w = F.lit([float(c) for c in self.coef])
        dot = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return dot + F.lit(float(self.intercept))


def _path(c: np.ndarray, b: np.ndarray, alphas: np.ndarray, rho: float, iters: int = 2000, tol: float = 1e-7) -> np.ndarray:
    """Elastic-net weights for all strengths at once (accelerated proximal steps); c, b per sample."""
    lip = max(float(np.linalg.eigvalsh(c)[-1]), 1e-12) + alphas * (1.0 - rho)
    w = np.zeros((len(b), len(alphas)))
    v, t = w.copy(), 1.0
    for _ in range(iters):
        grad = c @ v - b[:, None] + v * (alphas * (1.0 - rho))
        step = v - grad / lip
        new = np.sign(step) * np.maximum(np.abs(step) - alphas * rho / lip, 0.0)
        if float(np.sum((v - new) * (new - w))) > 0:  # restart when momentum points uphill
            t = 1.0
        nt = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        v = new + (t - 1.0) / nt * (new - w)
        done = np.max(np.abs(new - w)) <= tol * max(np.max(np.abs(new)), 1e-12)
        w, t = new, nt
        if done:
            break
    return w


class FoldSums:
    """Cross products per fold of ``(label, fold, features ARRAY)``: every later fit is data-free."""

    def __init__(self, df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold"):
        self.df, self.features, self.label, self.fold = df, features, label, fold
        joined = df.select(fold, F.concat(F.col(features), F.array(F.col(label).cast("double"))).alias("_z"))
        self.sums = fold_grams(joined, "_z", fold)
        self.folds = sorted(self.sums)
        self.total = sum(self.sums.values())
        self.width = len(self.total) - 2

    def _parts(self, cols: np.ndarray, without: int | None):
        g = self.total if without is None else self.total - self.sums[without]
        n = g[0, 0]
        x = cols + 1
        mx, my = g[0, x] / n, g[0, -1] / n
        c = g[np.ix_(x, x)] / n - np.outer(mx, mx)
        b = g[x, -1] / n - mx * my
        return n, mx, my, c, b

    def _full(self, cols, w, mx, my, alpha, rho) -> LinearFit:
        coef = np.zeros(self.width)
        coef[cols] = w
        return LinearFit(coef, float(my - mx @ w), float(alpha), rho)

    def fit(self, alpha: float, rho: float | None, cols: Sequence[int] | None = None, without: int | None = None) -> LinearFit:
        """One model on all folds, or on all but one."""
        cols = np.arange(self.width) if cols is None else np.asarray(cols)
        n, mx, my, c, b = self._parts(cols, without)
        if rho is None:
            w = np.linalg.solve(c + np.eye(len(cols)) * max(alpha / n, 1e-12), b)
        else:
            w = _path(c, b, np.array([alpha]), rho)[:, 0]
        return self._full(cols, w, mx, my, alpha, rho)

    def alpha_path(self, rho: float, count: int, cols: np.ndarray, without: int | None = None, eps: float = 1e-3) -> np.ndarray:
        """Log-spaced strengths from the smallest that zeroes every weight."""
        _, _, _, _, b = self._parts(cols, without)
        top = max(float(np.max(np.abs(b))) / max(rho, 1e-3), 1e-12)
        return np.geomspace(top, top * eps, count)

    def tune(self, ratios: Sequence[float], n_alphas: int = 50, cols: Sequence[int] | None = None) -> LinearFit:
        """Elastic net with strength and ratio chosen by the mean squared error over the folds."""
        cols = np.arange(self.width) if cols is None else np.asarray(cols)
        best = (np.inf, None, None)
        for rho in ratios:
            alphas = self.alpha_path(rho, n_alphas, cols)
            err = np.zeros(n_alphas)
            for f in self.folds:
                _, mx, my, c, b = self._parts(cols, f)
                w = _path(c, b, alphas, rho)
                err += self._mse(f, cols, w, my - mx @ w) / len(self.folds)
            i = int(np.argmin(err))
            if err[i] < best[0]:
                best = (err[i], float(alphas[i]), rho)
        return self.fit(best[1], best[2], cols)

    def ridge_errors(self, alphas: Sequence[float]) -> np.ndarray:
        """Mean squared error out of fold of every ridge strength, averaged over the folds."""
        cols, err = np.arange(self.width), np.zeros(len(alphas))
        for f in self.folds:
            n, mx, my, c, b = self._parts(cols, f)
            values, vectors = np.linalg.eigh(c)
            w = vectors @ ((vectors.T @ b)[:, None] / np.maximum(values[:, None] + np.asarray(alphas) / n, 1e-12))
            err += self._mse(f, cols, w, my - mx @ w) / len(self.folds)
        return err

    def _mse(self, f: int, cols: np.ndarray, w: np.ndarray, shift: np.ndarray) -> np.ndarray:
        g = self.sums[f]
        pick = np.concatenate([[0], cols + 1])
        full = np.vstack([shift[None, :], w])
        q = np.einsum("ij,ij->j", full, g[np.ix_(pick, pick)] @ full)
        return (g[-1, -1] - 2.0 * g[-1, pick] @ full + q) / g[0, 0]

    def held_out_scores(self, candidates: dict[str, dict[int, LinearFit]]) -> DataFrame:
        """``(name, n, mae, r2)`` of every candidate on the rows of the fold it did not see.

        ``candidates`` maps a name to one fit per held-out fold; all are scored in one pass.
        """
        names = list(candidates)
        w = {f: np.stack([candidates[c][f].coef for c in names], axis=1) for f in self.folds}
        shift = {f: np.array([candidates[c][f].intercept for c in names]) for f in self.folds}

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for f, part in pdf.groupby("fold"):
                    x, y = np.vstack(part["x"].to_numpy()), part["y"].to_numpy()
                    e = x @ w[int(f)] + shift[int(f)] - y[:, None]
                    yield pd.DataFrame(
                        {
                            "name": names, "n": len(y), "abs_sum": np.abs(e).sum(axis=0), "sq_sum": (e * e).sum(axis=0),
                            "y_sum": y.sum(), "yy_sum": (y * y).sum(),
                        }
                    )

        rows = self.df.select(
            F.col(self.fold).cast("int").alias("fold"), F.col(self.label).cast("double").alias("y"), F.col(self.features).alias("x")
        )
        parts = rows.mapInPandas(
            partial, "name STRING, n BIGINT, abs_sum DOUBLE, sq_sum DOUBLE, y_sum DOUBLE, yy_sum DOUBLE"
        )
        n = F.sum("n")
        ss = F.sum("yy_sum") - F.sum("y_sum") * F.sum("y_sum") / n
        return parts.groupBy("name").agg(
            n.alias("n"),
            (F.sum("abs_sum") / n).alias("mae"),
            F.coalesce(1 - F.try_divide(F.sum("sq_sum"), ss), F.lit(0.0)).alias("r2"),
        )

    def per_fold(self, alpha: float, rho: float | None, cols: Sequence[int] | None = None) -> dict[int, LinearFit]:
        return {f: self.fit(alpha, rho, cols, without=f) for f in self.folds}

    def score(self, candidates: dict[str, tuple[float, float | None, Sequence[int] | None]]) -> DataFrame:
        """``(name, n, mae, r2)`` of every (strength, ratio, features), each row predicted without its fold."""
        return self.held_out_scores({name: self.per_fold(*one) for name, one in candidates.items()})


def design_sums(rows: DataFrame):
    """What a search runs on: cross products of the features, or of the samples where these are fewer.

    ``rows``: (sample_id, label, fold, features ARRAY).  A width beyond ``MAX_FEATURES`` needs at most
    ``sample_space.MAX_SAMPLES`` samples.
    """
    from cpgloom.operators.sample_space import FIRST, MAX_SAMPLES, DualSums, SampleSpace

    size = rows.agg(F.max(F.size("features")).alias("width"), F.count("*").alias("n")).first()
    if size["width"] <= MAX_FEATURES and (size["width"] <= size["n"] or size["n"] > MAX_SAMPLES):
        return FoldSums(rows) if size["width"] <= FIRST else DualSums(rows)
    return SampleSpace.from_rows(rows)


def random_penalties(n: int, seed: int, low: float = 1e-4, high: float = 10.0) -> list[tuple[float, float]]:
    """Seeded draws of (alpha log-uniform, rho uniform)."""
    rng = np.random.default_rng(seed)
    return [(float(np.exp(rng.uniform(np.log(low), np.log(high)))), float(rng.uniform(0.05, 1.0))) for _ in range(n)]


def random_search(sums, n: int = 20, seed: int = 42) -> DataFrame:
    """Trial table of a random search: all trials are scored together, ranked by MAE."""
    draws = random_penalties(n, seed)
    scores = sums.score({f"{i:04d}": (a, rho, None) for i, (a, rho) in enumerate(draws)})
    spark = scores.sparkSession
    params = spark.createDataFrame([(f"{i:04d}", a, rho) for i, (a, rho) in enumerate(draws)], "name STRING, alpha DOUBLE, rho DOUBLE")
    return scores.join(F.broadcast(params), "name").withColumnRenamed("name", "trial").orderBy("mae", "trial")


def eliminate(sums, step: int = 50, smallest: int = 50, alpha: float = 0.1, rho: float = 0.5) -> tuple[DataFrame, dict[str, list[int]]]:
    """Recursive elimination: drop the weakest weights step by step, score every size out of fold."""
    cols = list(range(sums.width))
    sizes: dict[str, list[int]] = {}
    while True:
        sizes[f"{len(cols):05d}"] = list(cols)
        if len(cols) <= smallest:
            break
        strength = np.abs(sums.fit(alpha, rho, cols).coef[cols])
        drop = min(step, len(cols) - smallest)
        weakest = set(np.argsort(strength, kind="stable")[:drop])
        cols = [c for i, c in enumerate(cols) if i not in weakest]
    scores = sums.score({name: (alpha, rho, kept) for name, kept in sizes.items()})
    return scores.withColumn("n_features", F.col("name").cast("long")), sizes


def k_sweep(sums, sizes: Sequence[int], alpha: float = 0.1, rho: float = 0.5) -> DataFrame:
    """Score prefixes of a ranked feature list; every prefix comes from the same sums."""
    scores = sums.score({f"{k:05d}": (alpha, rho, range(min(k, sums.width))) for k in sizes})
    return scores.withColumn("k", F.col("name").cast("long")).drop("name")


def tuned_elastic_net(df: DataFrame, ratios: Sequence[float], n_alphas: int = 50) -> LinearFit:
    """Cross-validated elastic net on (sample_id, label, fold, features ARRAY) of any width."""
    return design_sums(df).tune(ratios, n_alphas)


def vector_arrays(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn(col, vector_to_array(F.col(col)))
