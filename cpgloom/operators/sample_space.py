"""Linear models of designs with more features than samples, solved in the space of the samples.

The design is a table with one row per feature: its values for all samples, in one order.  Samples are few
(``MAX_SAMPLES`` at most, checked), features may be many and are never held together.

*Ridge* needs only the Gram matrix of the samples, a sum over features that tasks add up with BLAS.  Every
fold and every strength is then a small system: the matrix of the training samples is a corner of it.

*Elastic net* is solved in its dual, one unknown per sample.  With ``t`` the residuals over ``n``, the weights are
``soft(x_j't, alpha rho) / (alpha (1 - rho))``, and ``n t - y + X w(t) = 0`` is the gradient of a convex function of ``t``,
solved by Newton steps on the active columns (a proximal term stands in where ``rho`` is 1).  All problems of a
search are solved together, one task per path, on a working set of columns.  One pass over the table then checks
every other feature against the optimality condition of every problem; the worst offenders join the set,
which at most doubles, until no feature offends.  The result is the optimum over all features, not over the
working set.  Nothing of the size features x features exists anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.linear import FoldSums, LinearFit
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

# The Gram matrix of so many samples is 128 MB.
MAX_SAMPLES = 4000
# Bytes of the working set's columns, on the driver and in each task of a search.
MAX_WORKING = 256 << 20
# Features of the first working set.
FIRST = 512
# Slack of the optimality check, as a share of the penalty.
SLACK = 1e-7


@dataclass
class Problem:
    """An elastic net on all samples but one fold, over the features ``cols`` (ids, ascending; None: all)."""

    alpha: float
    rho: float
    without: int | None = None
    cols: np.ndarray | None = None


@dataclass
class Solved:
    theta: np.ndarray  # residuals over the number of training samples; 0 elsewhere
    features: np.ndarray
    coef: np.ndarray
    intercept: float
    predicted: np.ndarray  # of every sample


def soft(z: np.ndarray, by: float) -> np.ndarray:
    return np.sign(z) * np.maximum(np.abs(z) - by, 0.0)


def newton(
    x: np.ndarray, y: np.ndarray, alpha: float, rho: float, theta: np.ndarray | None = None, steps: int = 100, tol: float = 1e-11, square: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Dual and weights of the elastic net of centred ``x`` and ``y``; ``square`` is ``x'x``, where it is known."""
    n, m = x.shape
    theta = y / n if theta is None else theta
    scale = max(float(np.abs(y).max(initial=0.0)), 1e-300)
    # Without a quadratic term of its own, the problem gets one around the last weights, until these stand.
    prox = 0.0 if alpha * (1.0 - rho) > 1e-12 * max(alpha, 1.0) else max(alpha, 1e-8)
    c, centre, w = alpha * (1.0 - rho) + prox, np.zeros(m), np.zeros(m)
    for _ in range(1 if not prox else 500):
        z = x.T @ theta + prox * centre
        for _ in range(steps):
            w = soft(z, alpha * rho) / c
            grad = n * theta - y + x @ w
            if np.abs(grad).max(initial=0.0) <= tol * scale:
                break
            active = x[:, w != 0]
            k = active.shape[1]
            if k == 0:
                step = -grad / n
            elif k < n:  # the smaller of two equivalent systems
                met = active.T @ active if square is None else square[np.ix_(w != 0, w != 0)]
                inner = np.linalg.solve(met + c * n * np.eye(k), active.T @ grad)
                step = -(grad - active @ inner) / n
            else:
                step = -np.linalg.solve(active @ active.T / c + n * np.eye(n), grad)
            value = n / 2 * theta @ theta - y @ theta + c / 2 * w @ w
            along, size, ahead = grad @ step, 1.0, x.T @ step
            while size > 1e-10:
                new, w_new = theta + size * step, soft(z + size * ahead, alpha * rho) / c
                if n / 2 * new @ new - y @ new + c / 2 * w_new @ w_new <= value + 1e-4 * size * along + 1e-14 * abs(value):
                    break
                size /= 2
            theta, z = theta + size * step, z + size * ahead
        if prox and np.abs(w - centre).max(initial=0.0) <= 1e-10 * max(np.abs(w).max(initial=0.0), 1e-12):
            break
        centre = w
    return theta, w


def _columns(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Features by samples."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)


class SampleSpace:
    """A design by features with the labels and folds of its samples; searches run over all of it.

    ``columns``: (feature BIGINT from 0, x ARRAY<DOUBLE> in the order of ``samples``), stored.
    """

    def __init__(self, columns: DataFrame, samples: Sequence[str], label: np.ndarray, fold: np.ndarray | None = None):
        self.columns, self.samples, self.label = columns, list(samples), np.asarray(label, float)
        self.fold = np.zeros(len(self.label), int) if fold is None else np.asarray(fold, int)
        self.folds = sorted(set(self.fold.tolist()))
        self.width = int(columns.agg(F.max("feature")).first()[0] + 1)
        self._gram: np.ndarray | None = None

    @staticmethod
    def from_cells(cells: DataFrame, samples: DataFrame, value: str = "z", feature: str = "feature") -> SampleSpace:
        """From complete long cells (``sample_id``, feature, value) and ``samples`` (sample_id, label, and a fold if any)."""
        has_fold = "fold" in samples.columns
        rows = samples.select("sample_id", "label", *(["fold"] if has_fold else [])).orderBy("sample_id").limit(MAX_SAMPLES + 1).collect()
        if len(rows) > MAX_SAMPLES:
            raise ValueError(f"more than {MAX_SAMPLES} samples: use cross products of features or Spark's own solvers")
        spark, n = cells.sparkSession, len(rows)
        places = spark.createDataFrame([(r["sample_id"], i) for i, r in enumerate(rows)], "sample_id STRING, _at INT")
        placed = cells.join(F.broadcast(places), "sample_id")  # at most MAX_SAMPLES rows
        pairs = F.sort_array(F.collect_list(F.struct("_at", F.col(value).cast("double").alias("v"))))
        full = F.when(F.size("p") == n, F.col("p.v")).otherwise(F.raise_error(F.lit("a feature lacks samples: impute first")))
        wide = placed.groupBy(F.col(feature).cast("long").alias("feature")).agg(pairs.alias("p")).select("feature", full.alias("x"))
        return SampleSpace(
            materialize(wide, "columns"), [r["sample_id"] for r in rows], [r["label"] for r in rows], [r["fold"] for r in rows] if has_fold else None
        )

    @staticmethod
    def from_rows(rows: DataFrame) -> SampleSpace:
        """From (sample_id, label, features ARRAY) and a fold if any."""
        cells = rows.select("sample_id", F.posexplode("features").alias("feature", "z"))
        return SampleSpace.from_cells(cells, rows.drop("features"))

    # --- ridge ------------------------------------------------------------------------------------

    def gram(self) -> np.ndarray:
        """Products of all pairs of samples, summed over the features."""
        if self._gram is None:
            n = len(self.label)

            def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((n, n))
                for batch in batches:
                    x = _columns(batch, n)
                    total += x.T @ x
                yield pa.record_batch([pa.array(range(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

            parts = self.columns.select("x").mapInArrow(partial, "i INT, row ARRAY<DOUBLE>")
            total = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("row"))
            self._gram = np.zeros((n, n))
            for r in total.collect():  # one row per sample
                self._gram[r["i"]] = r["row"].toArray()
        return self._gram

    def _ridge_duals(self, alphas: Sequence[float], without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Dual vectors (samples by strengths; 0 outside the training samples) and intercepts."""
        train = np.ones(len(self.label), bool) if without is None else self.fold != without
        k = self.gram()[np.ix_(train, train)]
        k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
        mean = self.label[train].mean()
        values, vectors = np.linalg.eigh(k)
        turned = vectors.T @ (self.label[train] - mean)
        dual = np.zeros((len(self.label), len(alphas)))
        # Directions without any spread, the constant among them, carry no weight.
        usable = values > 1e-12 * max(values[-1], 1e-300)
        dual[train] = vectors[:, usable] @ (turned[usable, None] / (values[usable, None] + np.asarray(alphas)))
        return dual, mean - (self.gram()[train] @ dual).mean(0)

    def ridge_errors(self, alphas: Sequence[float]) -> np.ndarray:
        """Mean squared error out of fold of every strength, averaged over the folds; no pass over the features."""
        err = np.zeros(len(alphas))
        for f in self.folds:
            test = self.fold == f
            dual, shift = self._ridge_duals(alphas, f)
            err += ((self.gram()[test] @ dual + shift - self.label[test, None]) ** 2).mean(0) / len(self.folds)
        return err

    def ridge(self, alpha: float, without: int | None = None) -> LinearFit:
        dual, shift = self._ridge_duals([alpha], without)
        n, t = len(self.label), dual[:, 0]

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column("feature"), pa.array(_columns(batch, n) @ t)], ["feature", "coef"])

        coef = np.zeros(self.width)
        found = self.columns.mapInArrow(weigh, "feature BIGINT, coef DOUBLE").toPandas()  # one number per feature
        coef[found["feature"]] = found["coef"]
        return LinearFit(coef, float(shift[0]), float(alpha), None)

    # --- elastic net ------------------------------------------------------------------------------

    def _products(self, duals: np.ndarray) -> DataFrame:
        """Largest product of every feature with any of the given dual vectors."""
        n = len(self.label)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = np.abs(_columns(batch, n) @ duals)
                yield pa.record_batch([batch.column("feature"), batch.column("x"), pa.array(u.max(1))], ["feature", "x", "worst"])

        return self.columns.mapInArrow(work, "feature BIGINT, x ARRAY<DOUBLE>, worst DOUBLE")

    def _centred_label(self, without: int | None) -> np.ndarray:
        """Dual vector of the empty model."""
        train = np.ones(len(self.label), bool) if without is None else self.fold != without
        return np.where(train, (self.label - self.label[train].mean()) / train.sum(), 0.0)

    def alpha_path(self, rho: float, count: int, eps: float = 1e-3) -> np.ndarray:
        """Log-spaced strengths from the smallest that zeroes every weight."""
        top = self._products(self._centred_label(None)[:, None]).agg(F.max("worst")).first()[0]
        top = max(float(top) / max(rho, 1e-3), 1e-12)
        return np.geomspace(top, top * eps, count)

    def _offenders(self, problems: list[Problem], solved: list[Solved], ids: np.ndarray) -> DataFrame:
        """Features outside the working set that break the optimality of some problem, worst first."""
        n = len(self.label)
        duals = np.stack([s.theta for s in solved], axis=1)
        bound = np.array([p.alpha * p.rho for p in problems])
        spans: dict[int, tuple[np.ndarray, list[int]]] = {}
        for q, p in enumerate(problems):
            if p.cols is not None:
                spans.setdefault(id(p.cols), (p.cols, []))[1].append(q)
        spans_ = list(spans.values())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = np.abs(_columns(batch, n) @ duals)
                feature = batch.column("feature").to_numpy()
                for cols, which in spans_:
                    u[np.ix_(~np.isin(feature, cols), which)] = 0.0
                # Products below the noise of the sums offend nobody.
                over = (u - bound * (1 + SLACK) - 1e-12).max(1)
                bad = (over > 0) & ~np.isin(feature, ids)
                if bad.any():
                    pick = np.flatnonzero(bad)
                    yield pa.record_batch([batch.column("feature").take(pa.array(pick)), batch.column("x").take(pa.array(pick)), pa.array(over[pick])], ["feature", "x", "over"])

        return self.columns.mapInArrow(work, "feature BIGINT, x ARRAY<DOUBLE>, over DOUBLE").orderBy(F.desc("over"), "feature")

    def solve(self, paths: list[list[Problem]]) -> list[list[Solved]]:
        """All problems, optimal over all features.  The problems of a path share their fold and start from each other."""
        problems = [p for path in paths for p in path]
        empty = np.stack([self._centred_label(f) for f in sorted({p.without for p in problems}, key=str)], axis=1)
        first = self._products(empty).orderBy(F.desc("worst"), "feature").limit(FIRST).collect()
        ids = np.array([r["feature"] for r in first], np.int64)
        work = np.array([r["x"] for r in first], float).reshape(len(first), len(self.label))
        starts: list[list[np.ndarray | None]] = [[None] * len(path) for path in paths]
        while True:
            order = np.argsort(ids)
            ids, work = ids[order], work[order]
            solved = self._solve_working(paths, ids, work, starts)
            flat = [s for path in solved for s in path]
            more = self._offenders(problems, flat, ids).limit(max(len(ids), FIRST)).collect()
            if not more:
                return solved
            if (len(ids) + len(more)) * len(self.label) * 8 > MAX_WORKING:
                raise ValueError(f"more than {len(ids)} features are active at once: raise the smallest strength")
            ids = np.concatenate([ids, [r["feature"] for r in more]])
            work = np.vstack([work, [r["x"] for r in more]])
            starts = [[s.theta for s in path] for path in solved]

    def _solve_working(self, paths: list[list[Problem]], ids: np.ndarray, work: np.ndarray, starts: list) -> list[list[Solved]]:
        """Every path in a task of its own, on the working columns."""
        label, fold = self.label, self.fold

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in batch["path"]:
                    out, theta = [], None
                    for j, (p, begin) in enumerate(zip(paths[i], starts[i], strict=True)):
                        train = np.ones(len(label), bool) if p.without is None else fold != p.without
                        mine = np.arange(len(ids)) if p.cols is None else np.flatnonzero(np.isin(ids, p.cols))
                        x = work[mine]
                        mean, top = x[:, train].mean(1) if len(mine) else np.zeros(0), label[train].mean()
                        begin = theta if begin is None else begin[train]
                        theta, w = newton((x[:, train] - mean[:, None]).T, label[train] - top, p.alpha, p.rho, begin)
                        shift = float(top - mean @ w)
                        whole = np.zeros(len(label))
                        # From the weights, so that the check over all features sees what the weights leave.
                        whole[train] = (label[train] - x[:, train].T @ w - shift) / train.sum()
                        on = np.flatnonzero(w)
                        out.append((i, j, whole, ids[mine[on]], w[on], shift, x.T @ w + shift))
                    yield pd.DataFrame(out, columns=["path", "place", "theta", "features", "coef", "intercept", "predicted"])

        spark = self.columns.sparkSession
        asked = spark.range(len(paths), numPartitions=len(paths)).withColumnRenamed("id", "path")
        schema = "path BIGINT, place INT, theta ARRAY<DOUBLE>, features ARRAY<BIGINT>, coef ARRAY<DOUBLE>, intercept DOUBLE, predicted ARRAY<DOUBLE>"
        rows = {(r["path"], r["place"]): r for r in asked.mapInPandas(run, schema).collect()}  # one row per problem
        return [
            [
                Solved(*[np.array(rows[i, j][c], k) for c, k in (("theta", float), ("features", np.int64), ("coef", float))], rows[i, j]["intercept"], np.array(rows[i, j]["predicted"]))
                for j in range(len(path))
            ]
            for i, path in enumerate(paths)
        ]

    def _full(self, s: Solved, alpha: float, rho: float) -> LinearFit:
        coef = np.zeros(self.width)
        coef[s.features] = s.coef
        return LinearFit(coef, s.intercept, float(alpha), rho)

    def fit(self, alpha: float, rho: float | None, cols: Sequence[int] | None = None, without: int | None = None) -> LinearFit:
        """One model on all folds, or on all but one."""
        if rho is None:
            if cols is not None:
                space = self.only(cols)
                return space.ridge(alpha, without)
            return self.ridge(alpha, without)
        span = None if cols is None else np.sort(np.asarray(cols, np.int64))
        return self._full(self.solve([[Problem(alpha, rho, without, span)]])[0][0], alpha, rho)

    def only(self, cols: Sequence[int]) -> SampleSpace:
        """The same samples with some of the features; weights keep their places."""
        picked = self.columns.sparkSession.createDataFrame([(int(c),) for c in cols], "feature BIGINT")
        space = SampleSpace(self.columns.join(sized(picked), "feature", "left_semi"), self.samples, self.label, self.fold)
        space.width = self.width
        return space

    def tune(self, ratios: Sequence[float], n_alphas: int = 50) -> LinearFit:
        """Elastic net with strength and ratio chosen by the mean squared error over the folds."""
        grid = {rho: self.alpha_path(rho, n_alphas) for rho in ratios}
        keys = [(rho, f) for rho in ratios for f in self.folds]
        solved = self.solve([[Problem(float(a), rho, f) for a in grid[rho]] for rho, f in keys])
        err = {rho: np.zeros(n_alphas) for rho in ratios}
        for (rho, f), path in zip(keys, solved, strict=True):
            test = self.fold == f
            gaps = np.array([((s.predicted[test] - self.label[test]) ** 2).mean() for s in path])
            err[rho] += gaps / len(self.folds)
        best = min(ratios, key=lambda rho: err[rho].min())
        return self.fit(float(grid[best][int(err[best].argmin())]), best)

    def score(self, candidates: dict[str, tuple[float, float | None, Sequence[int] | None]]) -> DataFrame:
        """``(name, n, mae, r2)`` of every (strength, ratio, features), each sample predicted without its fold."""
        asked, paths, errors = [], [], {}
        for name, (alpha, rho, cols) in candidates.items():
            if rho is None:
                space = self if cols is None else self.only(cols)
                out = np.zeros(len(self.label))
                for f in self.folds:
                    dual, shift = space._ridge_duals([alpha], f)
                    out[self.fold == f] = (space.gram()[self.fold == f] @ dual + shift)[:, 0]
                errors[name] = out
                continue
            span = None if cols is None else np.sort(np.asarray(cols, np.int64))
            for f in self.folds:
                asked.append((name, f))
                paths.append([Problem(alpha, rho, f, span)])
        for (name, f), path in zip(asked, self.solve(paths) if paths else [], strict=True):
            errors.setdefault(name, np.zeros(len(self.label)))[self.fold == f] = path[0].predicted[self.fold == f]
        spread = float(((self.label - self.label.mean()) ** 2).sum())
        rows = []
        for name, out in errors.items():
            e = out - self.label
            rows.append((name, len(e), float(np.abs(e).mean()), 1.0 - float(e @ e) / spread if spread else 0.0))
        return self.columns.sparkSession.createDataFrame(rows, "name STRING, n BIGINT, mae DOUBLE, r2 DOUBLE")


class DualSums(FoldSums):
    """Cross products of a wide design of any number of samples: elastic nets solved to their optimum, a task a path.

    A root of the cross products of features and label stands in for the rows: it has features + 1 lines however
    many samples there are, and its elastic nets are those of the rows.
    """

    def _root(self, without: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        """Lines whose products are the mean centred products of [features, label], and the means of both."""
        n, mx, my, c, b = self._parts(np.arange(self.width), without)
        g = self.total if without is None else self.total - self.sums[without]
        values, vectors = np.linalg.eigh(np.block([[c, b[:, None]], [b[None], g[-1, -1] / n - my * my]]))
        return np.sqrt(np.maximum(values, 0.0) * len(values))[:, None] * vectors.T, mx, my

    def solve(self, paths: list[list[Problem]]) -> list[list[LinearFit]]:
        """All problems.  Those of a path share their fold and features and start from each other."""
        width, roots = self.width, {f: self._root(f) for f in {path[0].without for path in paths}}

        def solved(path: list[Problem]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
            root, mx, my = roots[path[0].without]
            cols = np.arange(width) if path[0].cols is None else path[0].cols
            x, theta = root[:, cols], None
            square = x.T @ x
            for p in path:
                theta, w = newton(x, root[:, -1], p.alpha, p.rho, theta, square=square)
                on = np.flatnonzero(w)
                yield cols[on], w[on], float(my - mx[cols] @ w)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in batch["path"]:
                    yield pd.DataFrame([(i, j, *one) for j, one in enumerate(solved(paths[i]))], columns=["path", "place", "features", "coef", "intercept"])

        if len(paths) == 1 and len(paths[0]) == 1:
            rows = {(0, 0): dict(zip(("features", "coef", "intercept"), next(solved(paths[0])), strict=True))}
        else:
            asked = self.df.sparkSession.range(len(paths), numPartitions=len(paths)).withColumnRenamed("id", "path")
            schema = "path BIGINT, place INT, features ARRAY<BIGINT>, coef ARRAY<DOUBLE>, intercept DOUBLE"
            rows = {(r["path"], r["place"]): r for r in asked.mapInPandas(run, schema).collect()}  # one row per problem

        def full(r, p: Problem) -> LinearFit:
            coef = np.zeros(width)
            coef[np.asarray(r["features"], np.int64)] = r["coef"]
            return LinearFit(coef, r["intercept"], float(p.alpha), p.rho)

        return [[full(rows[i, j], p) for j, p in enumerate(path)] for i, path in enumerate(paths)]

    def fit(self, alpha: float, rho: float | None, cols: Sequence[int] | None = None, without: int | None = None) -> LinearFit:
        if rho is None:
            return super().fit(alpha, rho, cols, without)
        return self.solve([[Problem(alpha, rho, without, _span(cols))]])[0][0]

    def tune(self, ratios: Sequence[float], n_alphas: int = 50, cols: Sequence[int] | None = None) -> LinearFit:
        span, every = _span(cols), np.arange(self.width) if cols is None else np.asarray(cols)
        grid = {rho: self.alpha_path(rho, n_alphas, every) for rho in ratios}
        keys = [(rho, f) for rho in ratios for f in self.folds]
        solved = self.solve([[Problem(float(a), rho, f, span) for a in grid[rho]] for rho, f in keys])
        err = {rho: np.zeros(n_alphas) for rho in ratios}
        for (rho, f), path in zip(keys, solved, strict=True):
            w, shift = np.stack([one.coef for one in path], axis=1), np.array([one.intercept for one in path])
            err[rho] += self._mse(f, np.arange(self.width), w, shift) / len(self.folds)
        best = min(ratios, key=lambda rho: err[rho].min())
        return self.fit(float(grid[best][int(err[best].argmin())]), best, cols)

    def score(self, candidates: dict[str, tuple[float, float | None, Sequence[int] | None]]) -> DataFrame:
        fits = {name: self.per_fold(*one) for name, one in candidates.items() if one[1] is None}
        keys = [(name, f) for name in candidates if name not in fits for f in self.folds]
        paths = [[Problem(candidates[name][0], candidates[name][1], f, _span(candidates[name][2]))] for name, f in keys]
        for (name, f), path in zip(keys, self.solve(paths) if paths else [], strict=True):
            fits.setdefault(name, {})[f] = path[0]
        return self.held_out_scores(fits)


def _span(cols: Sequence[int] | None) -> np.ndarray | None:
    return None if cols is None else np.sort(np.asarray(cols, np.int64))


def weight_table(spark, fit: LinearFit) -> DataFrame:
    """``(feature, coef)`` of the weights that are not zero."""
    on = np.flatnonzero(fit.coef)
    return spark.createDataFrame(pd.DataFrame({"feature": on.astype(np.int64), "coef": fit.coef[on]}), "feature BIGINT, coef DOUBLE")


def predict_cells(cells: DataFrame, fit: LinearFit, value: str = "z", feature: str = "feature") -> DataFrame:
    """``(sample_id, prediction)`` of long cells; features without weight are not read into the sum."""
    weights = sized(weight_table(cells.sparkSession, fit).withColumnRenamed("feature", feature))
    term = F.coalesce(F.col("coef"), F.lit(0.0)) * F.col(value)
    return cells.join(weights, feature, "left").groupBy("sample_id").agg((F.sum(F.coalesce(term, F.lit(0.0))) + F.lit(float(fit.intercept))).alias("prediction"))


def optimality(cells: DataFrame, samples: DataFrame, fit: LinearFit, value: str = "z", feature: str = "feature") -> DataFrame:
    """Per feature: its product with the residuals over ``n`` minus the slope of the quadratic penalty (``pull``), its
    ``coef`` and by how much the optimality condition of the elastic net is missed (``gap``).

    Computed from cells and weights by joins and sums, apart from the solver.
    """
    n = samples.count()
    resid = predict_cells(cells, fit, value, feature).join(samples.select("sample_id", "label"), "sample_id")
    resid = sized(resid.select("sample_id", ((F.col("label") - F.col("prediction")) / n).alias("_r")))
    weights = sized(weight_table(cells.sparkSession, fit).withColumnRenamed("feature", feature))
    pulls = cells.join(resid, "sample_id").groupBy(feature).agg(F.sum(F.col(value) * F.col("_r")).alias("_u")).join(weights, feature, "left")
    coef = F.coalesce("coef", F.lit(0.0))
    pull = F.col("_u") - fit.alpha * (1 - fit.rho) * coef
    l1 = fit.alpha * fit.rho
    gap = F.when(coef == 0, F.greatest(F.abs(pull) - l1, F.lit(0.0))).otherwise(F.abs(pull - l1 * F.signum(coef)))
    return pulls.select(feature, pull.alias("pull"), coef.alias("coef"), gap.alias("gap"))
