"""Tree, residual, stacked and segment-wise models as Spark ML estimators.

All take ``(sample_id, label, features VECTOR)`` and add a ``prediction`` column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.functions.scalars import digitize
from cpgloom.operators.boosted import BoostedModel, BoostedTrees, Settings, fit_together
from cpgloom.operators.impute import neighbours
from cpgloom.operators.kernel import KernelRegressor
from cpgloom.operators.linear import LinearFit, Penalised, design_sums
from cpgloom.operators.ordering import exact_quantiles
from cpgloom.operators.saved import Saved
from cpgloom.operators.sizing import sized
from cpgloom.operators.splits import kfold, validation_split
from cpgloom.session import materialize

RATIOS = [0.1, 0.3, 0.5, 0.7, 0.9]


# Fits that run side by side where an estimator has no way to fit several data sets at once.
THREADS = 5
# Rows that a task of a forest holds: the bins of their features, and how often every tree draws them.
FOREST_BYTES = 128 << 20


class Forest(RandomForestRegressor):
    """Spark ML's forest over few partitions: every task sends the sums of all nodes it sees, so more tasks shuffle more of them.

    As many tasks as let fits side by side use every core, and more only where a task would hold too many rows.
    """

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        n, width = dataset.agg(F.count("*"), F.max(F.size(vector_to_array(self.getFeaturesCol())))).first()
        held = n * 4 * ((width or 0) + self.getNumTrees() + 16)
        cores = dataset.sparkSession.sparkContext.defaultParallelism
        return super()._fit(dataset.coalesce(max(1, -(-cores // THREADS), -(-held // FOREST_BYTES))))


def forest(trees: int = 100, depth: int = 10, min_leaf: int = 2, seed: int = 42) -> RandomForestRegressor:
    return Forest(numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, seed=seed)


def boosting(rounds: int = 100, depth: int = 3, rate: float = 0.1, rows: float = 0.8, cols: float = 0.8, seed: int = 42, label: str = "label", **told) -> BoostedTrees:
    return BoostedTrees(rounds=rounds, depth=depth, rate=rate, rows=rows, cols=cols, seed=seed, label=label, **told)


def side_by_side(calls: Sequence[Callable]) -> list:
    """What the calls return, a few at a time."""
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(lambda f: f(), calls))


def fit_each(est: Estimator, parts: dict[int, DataFrame]) -> dict[int, Model]:
    """One model for each numbered data set."""
    if hasattr(est, "fit_many"):
        return est.fit_many(parts)
    return dict(zip(parts, side_by_side([lambda df=df: est.fit(df) for df in parts.values()]), strict=True))


def numbered_union(parts: dict[int, DataFrame], *columns: str) -> DataFrame:
    """The data sets as one, with their number as ``model``."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("model"), *columns) for k, df in parts.items()])


class LinearModel(Model, Saved):
    """A :class:`LinearFit` over a vector column."""

    parts = ("fit_result",)

    def __init__(self, fit_result: LinearFit):
        super().__init__()
        self.fit_result = fit_result

    def _transform(self, df: DataFrame) -> DataFrame:
        return (
            df.withColumn("_x", vector_to_array("features"))
            .withColumn("prediction", self.fit_result.column("_x"))
            .drop("_x")
        )


class TunedElasticNet(Estimator, Saved):
    """Strength and ratio by inner cross-validation, for designs of any width."""

    parts = ("ratios", "n_alphas", "folds", "seed")

    def __init__(self, ratios: Sequence[float] = tuple(RATIOS), n_alphas: int = 50, folds: int = 3, seed: int = 42):
        super().__init__()
        self.ratios, self.n_alphas, self.folds, self.seed = list(ratios), n_alphas, folds, seed

    def _fit(self, df: DataFrame) -> LinearModel:
        rows = df.select("sample_id", "label", vector_to_array("features").alias("features"))
        # Row hashing is enough here: the inner folds only have to be fixed, not exactly equal.
        rows = rows.withColumn("fold", F.pmod(F.xxhash64("sample_id", F.lit(self.seed)), F.lit(self.folds)).cast("int"))
        return LinearModel(design_sums(rows).tune(self.ratios, self.n_alphas))


class NeighbourRegressor(Estimator, Saved):
    """Distance-weighted mean of the k nearest training labels."""

    parts = ("k",)

    def __init__(self, k: int = 8):
        super().__init__()
        self.k = k

    def _fit(self, df: DataFrame) -> NeighbourModel:
        return NeighbourModel(df.select("sample_id", "label", vector_to_array("features").alias("features")), self.k)


class NeighbourModel(Model, Saved):
    parts = ("train", "k")

    def __init__(self, train: DataFrame, k: int):
        super().__init__()
        self.train, self.k = train, k

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = df.select("sample_id", vector_to_array("features").alias("features"))
        near = neighbours(asked, self.train, self.k)
        labels = self.train.select(F.col("sample_id").alias("donor_id"), F.col("label").alias("_y"))
        d = F.col("distance")
        exact = F.avg(F.when(d == 0, F.col("_y")))
        weighted = F.try_divide(F.sum(F.when(d > 0, F.col("_y") / d)), F.sum(F.when(d > 0, 1.0 / d)))
        out = near.join(labels, "donor_id").groupBy("sample_id").agg(F.coalesce(exact, weighted).alias("prediction"))
        # Without a usable neighbour: the mean training label.
        mean = self.train.agg(F.avg("label")).first()[0]
        return df.join(out, "sample_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit(mean)))


class ResidualLearner(Estimator, Saved):
    """Linear model, boosted trees on its residuals, then a two-weight recalibration.

    The rows that stop the boosting come out of the training rows; neither the linear model nor
    the trees are fitted on them.  Several data sets grow their trees together.
    """

    parts = ("rounds", "depth", "rate", "n_alphas", "seed", "rows", "cols", "l1", "l2", "min_child", "patience")

    def __init__(
        self, rounds: int = 300, depth: int = 3, rate: float = 0.03, n_alphas: int = 50, seed: int = 7, rows: float = 0.7, cols: float = 0.5,
        l1: float = 10.0, l2: float = 50.0, min_child: float = 10.0, patience: int = 30,
    ):
        super().__init__()
        self.rounds, self.depth, self.rate, self.n_alphas, self.seed = rounds, depth, rate, n_alphas, seed
        self.rows, self.cols, self.l1, self.l2, self.min_child, self.patience = rows, cols, l1, l2, min_child, patience

    def _fit(self, df: DataFrame) -> ResidualModel:
        return self.fit_many({0: df})[0]

    def fit_many(self, parts: dict[int, DataFrame]) -> dict[int, ResidualModel]:
        every = numbered_union(parts, "sample_id", "label", "features")
        rows = materialize(validation_split(every, seed=self.seed, group=["model"]), "residual")
        mine = {k: rows.where(F.col("model") == k) for k in parts}
        lin = fit_each(TunedElasticNet(n_alphas=self.n_alphas), {k: df.where("not is_validation") for k, df in mine.items()})
        resid = numbered_union({k: lin[k].transform(df) for k, df in mine.items()}, "sample_id", "label", "features", "is_validation", F.col("prediction").alias("p_lin"))
        resid = materialize(resid, "residuals")
        settings = Settings(
            self.rounds, self.depth, self.rate, self.rows, self.cols, self.l1, self.l2, self.min_child, patience=self.patience, seed=self.seed
        )
        left = resid.select("model", "sample_id", (F.col("label") - F.col("p_lin")).alias("label"), "features", F.col("is_validation").alias("held"))
        trees = fit_together(left, settings)

        def recalibrated(k: int) -> DataFrame:
            both = trees[k].transform(resid.where(F.col("model") == k))
            return both.select("label", array_to_vector(F.array("p_lin", "prediction")).alias("features"))

        final = fit_each(Penalised(0.0), {k: recalibrated(k) for k in parts})
        return {k: ResidualModel(lin[k], trees[k], final[k]) for k in parts}


class ResidualModel(Model, Saved):
    parts = ("lin", "trees", "final")

    def __init__(self, lin: LinearModel, trees, final):
        super().__init__()
        self.lin, self.trees, self.final = lin, trees, final

    def _transform(self, df: DataFrame) -> DataFrame:
        staged = self.lin.transform(df).withColumnRenamed("prediction", "p_lin")
        staged = self.trees.transform(staged).withColumnRenamed("prediction", "r_hat")
        a, b = (float(c) for c in self.final.coefficients)
        total = a * F.col("p_lin") + b * F.col("r_hat") + float(self.final.intercept)
        return staged.withColumn("prediction", total)

    def linear_only(self, df: DataFrame) -> DataFrame:
        return self.lin.transform(df)

    def info(self) -> dict:
        """Chosen penalty, sparsity and recalibration weights."""
        fit = self.lin.fit_result
        return {
            "alpha": fit.alpha,
            "l1_ratio": fit.rho,
            "n_nonzero": int(np.sum(fit.coef != 0)),
            "n_trees": int(self.trees.n_trees),
            "w_linear": float(self.final.coefficients[0]),
            "w_residual": float(self.final.coefficients[1]),
            "bias": float(self.final.intercept),
        }


def out_of_fold(df: DataFrame, estimators: dict[str, Estimator], folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """``(model, sample_id, fold, y_true, y_pred)``: every sample predicted by models that never saw it."""
    train = {f: df.where(F.col(fold) != f) for f in folds}
    out = []
    for name, est in estimators.items():
        for f, model in fit_each(est, train).items():
            part = model.transform(df.where(F.col(fold) == f))
            out.append(part.select(F.lit(name).alias("model"), "sample_id", fold, F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")))
    return reduce(DataFrame.unionByName, out)


class Stacking(Estimator):
    """Base models, their out-of-fold predictions as features, a ridge on top.

    ``meta_alpha`` is the ridge's strength, or a list of which cross-validation picks one.  All data sets and all inner
    folds of a base model are fitted in one go.
    """

    def __init__(self, base: dict[str, Estimator], meta_alpha: float | Sequence[float] = 1.0, folds: int = 3, passthrough: bool = False, seed: int = 11):
        super().__init__()
        self.base, self.meta_alpha, self.folds, self.passthrough, self.seed = base, meta_alpha, folds, passthrough, seed

    def _fit(self, df: DataFrame) -> StackedModel:
        return self.fit_many({0: df})[0]

    def fit_many(self, parts: dict[int, DataFrame]) -> dict[int, StackedModel]:
        every = numbered_union(parts, "sample_id", "label", "features")
        rows = materialize(kfold(every, self.folds, self.seed, group=["model"], out="_fold"), "stacking")
        # The last set of every model is all its rows; the others lack one fold each.
        step = self.folds + 1
        sets = {k * step + f: rows.where((F.col("model") == k) & (F.col("_fold") != f)).drop("model") for k in parts for f in range(step)}
        fitted = {name: fit_each(est, sets) for name, est in self.base.items()}
        pieces = []
        for k in parts:
            for f in range(self.folds):
                part = rows.where((F.col("model") == k) & (F.col("_fold") == f))
                for name in self.base:
                    part = fitted[name][k * step + f].transform(part).withColumnRenamed("prediction", f"p_{name}")
                pieces.append(part)
        # The final fit reads this several times: predict once.
        staged = materialize(reduce(DataFrame.unionByName, pieces), "stacked")
        out = {}
        for k in parts:
            mine = _assembled(staged.where(F.col("model") == k), self.base, self.passthrough)
            final = Penalised(self._strength(mine)).fit(mine)
            out[k] = StackedModel({name: fitted[name][k * step + self.folds] for name in self.base}, final, self.passthrough)
        return out

    def _strength(self, mine: DataFrame) -> float:
        """The ridge's strength: as told, or that of the smallest squared error over the folds."""
        if not isinstance(self.meta_alpha, Sequence):
            return self.meta_alpha
        rows = mine.select("sample_id", "label", F.col("_fold").cast("int").alias("fold"), vector_to_array("features").alias("features"))
        sums = design_sums(rows)
        return float(list(self.meta_alpha)[int(np.argmin(sums.ridge_errors(self.meta_alpha)))])


def _assembled(staged: DataFrame, names: Iterable[str], passthrough: bool) -> DataFrame:
    inputs = [f"p_{n}" for n in names] + (["_raw"] if passthrough else [])
    staged = staged.withColumnRenamed("features", "_raw")
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(staged)


class StackedModel(Model, Saved):
    parts = ("models", "final", "passthrough")

    def __init__(self, models: dict[str, Model], final: Model, passthrough: bool):
        super().__init__()
        self.models, self.final, self.passthrough = models, final, passthrough

    def _transform(self, df: DataFrame) -> DataFrame:
        staged = df
        for name, m in self.models.items():
            staged = m.transform(staged).withColumnRenamed("prediction", f"p_{name}")
        out = self.final.transform(_assembled(staged, self.models, self.passthrough))
        return out.drop("features", *[f"p_{n}" for n in self.models]).withColumnRenamed("_raw", "features")


# Strengths from which the published stacks draw their meta penalty: 20, log-spaced.
META_ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 20))


def stack_members(rounds: int = 200) -> dict[str, Estimator]:
    """Base models of the published stacks; ``rounds`` is the number of trees of each tree model."""
    return {
        "enet": Penalised(0.1, 0.5),
        "ridge": Penalised(1.0),
        "lasso": Penalised(0.1, 1.0),
        "svr": KernelRegressor(c=1.0, epsilon=0.1),
        "knn": NeighbourRegressor(10),
        "forest": forest(rounds, 10, 3),
        "gbr": boosting(rounds, 3, 0.05, 0.8, 1.0, l2=0.0),
        "xgb": boosting(rounds, 3, 0.05, 1.0, 1.0),
        "lgbm": boosting(rounds, 5, 0.05, 1.0, 1.0, l2=0.0, min_child=20.0),
    }


def stacking_presets(rounds: int = 200) -> dict[str, Stacking]:
    """Linear, tree, mixed and full ensembles: five inner folds, the meta penalty picked by cross-validation."""
    m = stack_members(rounds)
    members = {
        "linear": ["enet", "ridge", "lasso"],
        "trees": ["forest", "gbr", "xgb", "lgbm"],
        "mixed": ["enet", "svr", "forest", "xgb"],
        "full": list(m),
    }
    return {name: Stacking({x: m[x] for x in mine}, META_ALPHAS, 5, passthrough=name == "full") for name, mine in members.items()}


class BandCorrection(Estimator):
    """A global model plus a ridge on its residuals per true age band, applied by predicted band."""

    def __init__(self, base: Estimator, bands: Sequence[float] = (0, 40, 65, 120), alpha: float = 10.0, smallest: int = 10):
        super().__init__()
        self.base, self.bands, self.alpha, self.smallest = base, list(bands), alpha, smallest

    def _fit(self, df: DataFrame) -> BandModel:
        model = self.base.fit(df)
        resid = model.transform(df).select("sample_id", "features", "label", (F.col("label") - F.col("prediction")).alias("residual"))
        resid = materialize(resid.withColumn("band", digitize("label", self.bands)), "bands")
        sizes = {r["band"]: r["count"] for r in resid.groupBy("band").count().collect()}  # one row per band
        fixes = {}
        for i in range(1, len(self.bands)):
            if sizes.get(i, 0) >= self.smallest:
                fixes[i] = Penalised(self.alpha, None, label="residual").fit(resid.where(F.col("band") == i))
        return BandModel(model, fixes, self.bands)


class BandModel(Model, Saved):
    parts = ("model", "fixes", "bands")

    def __init__(self, model: Model, fixes: dict, bands: list):
        super().__init__()
        self.model, self.fixes, self.bands = model, fixes, bands

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df).withColumnRenamed("prediction", "_base")
        out = out.withColumn("_band", digitize("_base", self.bands))
        shift = F.lit(0.0)
        for i, fix in self.fixes.items():
            out = fix.transform(out).withColumnRenamed("prediction", f"_fix{i}")
            shift = F.when(F.col("_band") == i, F.col(f"_fix{i}")).otherwise(shift)
        return out.withColumn("prediction", F.col("_base") + shift).drop("_base", "_band", *[f"_fix{i}" for i in self.fixes])


class SegmentedModel(Estimator, Saved):
    """Classify the age band with boosted trees, then predict with that band's linear model.

    One logistic model a band, grown together; the band of the largest margin wins.
    """

    parts = ("edges", "rounds", "smallest", "n_alphas")

    def __init__(self, edges: Sequence[float] = (40, 65), rounds: int = 50, smallest: int = 10, n_alphas: int = 30):
        super().__init__()
        self.edges, self.rounds, self.smallest, self.n_alphas = list(edges), rounds, smallest, n_alphas

    def _fit(self, df: DataFrame) -> SegmentedFit:
        rows = df.select("sample_id", "features", "label", digitize("label", self.edges).alias("band"))
        rows = materialize(rows, "segments")
        bands = range(len(self.edges) + 1)
        sizes = {int(r["band"]): r["count"] for r in rows.groupBy("band").count().collect()}  # one row per band
        large = [b for b in bands if sizes.get(b, 0) >= self.smallest]
        found = fit_each(TunedElasticNet(n_alphas=self.n_alphas), {-1: rows} | {b: rows.where(F.col("band") == b) for b in large})
        each = rows.withColumn("model", F.explode(F.array(*[F.lit(b) for b in bands])))
        each = each.select("model", "sample_id", "features", (F.col("band") == F.col("model")).cast("double").alias("label"), F.lit(False).alias("held"))
        router = fit_together(each, Settings(self.rounds, 3, 0.1, l2=0.0, objective="logistic"))
        return SegmentedFit(router, {b: found.get(b, found[-1]) for b in bands})


class SegmentedFit(Model, Saved):
    parts = ("router", "per_band")

    def __init__(self, router: dict[int, BoostedModel], per_band: dict[int, LinearModel]):
        super().__init__()
        self.router, self.per_band = router, per_band

    def _transform(self, df: DataFrame) -> DataFrame:
        margins = F.array(*[self.router[b].column() for b in sorted(self.router)])
        out = df.withColumn("_m", margins).withColumn("_x", vector_to_array("features"))
        out = out.withColumn("_route", F.array_position("_m", F.array_max("_m")) - 1)
        pred = F.lit(None).cast("double")
        for b, m in self.per_band.items():
            pred = F.when(F.col("_route") == b, m.fit_result.column("_x")).otherwise(pred)
        return out.select(*df.columns, F.col("_route").cast("long").alias("segment"), pred.alias("prediction"))


class TransformedTarget(Estimator):
    """Fit on a transformed label, predict on the original scale."""

    def __init__(self, base: Estimator, forward, inverse):
        super().__init__()
        self.base, self.forward, self.inverse = base, forward, inverse

    def _fit(self, df: DataFrame) -> TransformedModel:
        return TransformedModel(self.base.fit(df.withColumn("label", self.forward("label"))), self.inverse)


class TransformedModel(Model, Saved):
    parts = ("model", "inverse")

    def __init__(self, model: Model, inverse):
        super().__init__()
        self.model, self.inverse = model, inverse

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("prediction", self.inverse("prediction"))


class SplineRidge(Estimator):
    """Additive cubic splines: truncated powers at training quantiles, then ridge."""

    def __init__(self, knots: int = 4, alpha: float = 1.0):
        super().__init__()
        self.knots, self.alpha = knots, alpha

    def _fit(self, df: DataFrame) -> SplineModel:
        probs = [(i + 1) / (self.knots + 1) for i in range(self.knots)]
        long = df.select(F.posexplode(vector_to_array("features")).alias("i", "x"))
        names = [f"k{j}" for j in range(self.knots)]
        edges = exact_quantiles(long, ["i"], "x", probs, names).orderBy("i")
        at = [[float(r[n]) for n in names] for r in edges.collect()]  # one row per feature
        return SplineModel(at, Penalised(self.alpha).fit(_spline_columns(df, at)))


def _spline_columns(df: DataFrame, knots: list[list[float]]) -> DataFrame:
    places = F.lit([[float(k) for k in row] for row in knots])
    def basis(x, i):
        powers = F.transform(F.get(places, i), lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3)))
        return F.concat(F.array(x, x * x, x * x * x), powers)

    expanded = F.flatten(F.transform(vector_to_array("features"), basis))
    return df.withColumn("features", array_to_vector(expanded))


class SplineModel(Model, Saved):
    parts = ("knots", "model")

    def __init__(self, knots: list, model: Model):
        super().__init__()
        self.knots, self.model = knots, model

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_spline_columns(df.withColumn("_keep", F.col("features")), self.knots))
        return out.drop("features").withColumnRenamed("_keep", "features")


class FourierRidge(Estimator, Saved):
    """Smooth non-linear regression: random cosine features of an RBF kernel, then ridge.

    The projection is drawn from the seed on the driver and shipped once per task.
    """

    parts = ("size", "gamma", "alpha", "seed")

    def __init__(self, size: int = 200, gamma: float = 0.05, alpha: float = 1.0, seed: int = 42):
        super().__init__()
        self.size, self.gamma, self.alpha, self.seed = size, gamma, alpha, seed

    def lift(self, df: DataFrame) -> DataFrame:
        first = df.select("features").first()
        size, rng = self.size, np.random.default_rng(self.seed)
        w = rng.normal(0.0, np.sqrt(2.0 * self.gamma), (0 if first is None else len(first["features"]), size))
        b = rng.uniform(0.0, 2.0 * np.pi, size)

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list(np.sqrt(2.0 / size) * np.cos(np.vstack(v.to_numpy()) @ w + b))) if len(v) else v

        return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))

    def _fit(self, df: DataFrame) -> FourierModel:
        return FourierModel(self, Penalised(self.alpha).fit(self.lift(df)))


class FourierModel(Model, Saved):
    parts = ("owner", "model")

    def __init__(self, owner: FourierRidge, model: Model):
        super().__init__()
        self.owner, self.model = owner, model

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.owner.lift(df.withColumn("_keep", F.col("features"))))
        return out.drop("features").withColumnRenamed("_keep", "features")


def coefficient_table(fit: LinearFit, names: DataFrame, top: int = 100) -> DataFrame:
    """``(feature, coef, abs_coef)`` of the strongest weights; ``names`` maps rank to feature."""
    spark = names.sparkSession
    coefs = spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(fit.coef)], "rank BIGINT, coef DOUBLE")
    joined = coefs.join(sized(names.select("rank", "feature")), "rank")
    return joined.select("feature", "coef", F.abs("coef").alias("abs_coef")).orderBy(F.desc("abs_coef"), "feature").limit(top)
