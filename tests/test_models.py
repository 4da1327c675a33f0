import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from cpgloom.functions.scalars import age_to_clock, clock_to_age
from cpgloom.operators import clocks as ck
from cpgloom.operators import ensembles as en
from cpgloom.operators import linear as ln
from cpgloom.operators.gram import fold_grams


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n, k = 120, 6
    x = rng.normal(size=(n, k))
    y = 50 + x @ np.array([8.0, -4.0, 2.0, 0.0, 0.0, 1.0]) + rng.normal(0, 2.0, n)
    rows = [(f"s{i:03d}", float(y[i]), [float(v) for v in x[i]], i % 4) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id STRING, label DOUBLE, features ARRAY<DOUBLE>, fold INT").repartition(3).cache()
    return df, df.withColumn("features", array_to_vector("features")), x, y


def ridge_closed(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    return np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)


def enet_descent(x, y, alpha, rho, sweeps=3000):
    xc, yc = x - x.mean(0), y - y.mean()
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(sweeps):
        for j in range(len(w)):
            rest = yc - xc @ w + xc[:, j] * w[j]
            c = xc[:, j] @ rest / n
            w[j] = np.sign(c) * max(abs(c) - alpha * rho, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - rho))
    return w


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_matches_closed_form(data, alpha):
    arr, vec, x, y = data
    want = ridge_closed(x, y, alpha)
    assert np.allclose(ln.ridge(alpha).fit(vec).coefficients.toArray(), want, atol=1e-6)
    assert np.allclose(ln.FoldSums(arr).fit(alpha, None).coef, want, atol=1e-6)


@pytest.mark.parametrize("alpha, rho", [(0.1, 0.5), (1.0, 0.9), (0.5, 1.0), (2.0, 0.2)])
def test_elastic_net_matches_coordinate_descent(data, alpha, rho):
    arr, vec, x, y = data
    want = enet_descent(x, y, alpha, rho)
    assert np.allclose(ln.elastic_net(alpha, rho).fit(vec).coefficients.toArray(), want, atol=1e-4)
    assert np.allclose(ln.FoldSums(arr).fit(alpha, rho).coef, want, atol=1e-5)


def test_fold_sums_match_numpy(data):
    arr, _, x, y = data
    g = fold_grams(arr.select("fold", F.concat("features", F.array("label")).alias("z")), "z", "fold")
    for f in range(4):
        mine = np.arange(len(y)) % 4 == f
        z = np.hstack([np.ones((mine.sum(), 1)), x[mine], y[mine, None]])
        assert np.allclose(g[f], z.T @ z)


def test_held_out_scores_and_search(data):
    arr, _, x, y = data
    sums = ln.FoldSums(arr)
    got = sums.held_out_scores({"r": sums.per_fold(1.0, None)}).first()
    e = np.zeros(len(y))
    for f in range(4):
        test = np.arange(len(y)) % 4 == f
        w = ridge_closed(x[~test], y[~test], 1.0)
        e[test] = x[test] @ w + y[~test].mean() - x[~test].mean(0) @ w - y[test]
    assert got["mae"] == pytest.approx(np.abs(e).mean()) and got["n"] == len(y)
    assert got["r2"] == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())
    trials = ln.random_search(sums, 6).collect()
    assert len(trials) == 6 and trials[0]["mae"] == min(r["mae"] for r in trials)
    tuned = sums.tune([0.1, 0.9], 15)
    assert abs(tuned.coef[0] - 8) < 1 and tuned.alpha > 0
    scores, sizes = ln.eliminate(sums, step=2, smallest=2)
    assert sorted(r["n_features"] for r in scores.collect()) == [2, 4, 6]
    assert set(sizes["00002"]) == {0, 1}
    assert [r["k"] for r in ln.k_sweep(sums, [2, 6]).orderBy("k").collect()] == [2, 6]


def mae(model, df):
    return model.transform(df).agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("m")).first()["m"]


@pytest.mark.parametrize(
    "name, limit",
    [("enet", 2.5), ("forest", 5.0), ("boost", 5.0), ("fourier", 9.0), ("spline", 3.0), ("residual", 2.5), ("band", 3.0), ("target", 4.0)],
)
def test_models_predict_finite_values(data, name, limit):
    _, vec, _, _ = data
    est = {
        "enet": lambda: en.TunedElasticNet(n_alphas=10),
        "forest": lambda: en.forest(10, 5),
        "boost": lambda: en.boosting(10),
        "fourier": lambda: en.FourierRidge(100, 0.05, 0.1),
        "spline": lambda: en.SplineRidge(3),
        "residual": lambda: en.ResidualLearner(rounds=5, rate=0.1, n_alphas=10),
        "band": lambda: en.BandCorrection(ln.ridge(1.0)),
        "target": lambda: en.TransformedTarget(ln.ridge(1.0), age_to_clock, clock_to_age),
    }[name]()
    model = est.fit(vec)
    out = model.transform(vec).select("sample_id", "prediction").collect()
    assert len(out) == 120 and all(np.isfinite(r["prediction"]) for r in out)
    assert mae(model, vec) < limit
    if name == "residual":
        info = model.info()
        assert info["n_nonzero"] >= 3 and info["n_trees"] >= 1
        assert "prediction" in model.linear_only(vec).columns


def test_stacking_and_out_of_fold_cover_every_sample_once(data):
    _, vec, _, _ = data
    oof = en.out_of_fold(vec, {"a": ln.ridge(1.0), "b": ln.lasso(0.1)}, range(4))
    assert oof.groupBy("model", "sample_id").count().where("count <> 1").count() == 0 and oof.count() == 240
    stack = en.Stacking({"a": ln.ridge(1.0), "knn": en.NeighbourRegressor(5)}, passthrough=True).fit(vec)
    assert mae(stack, vec) < 2.5
    assert set(en.stacking_presets()) == {"linear", "trees", "mixed", "full"}


def test_the_registered_mixed_stack_is_the_published_one(spark, monkeypatch):
    """Failed when the query told its members 50 trees instead of the published 200."""
    from cpgloom.plans import catalog, model_queries

    monkeypatch.setattr(model_queries, "fit_and_predict", lambda _spark, _d, est, *_: est)
    stack = catalog.QUERIES["m08_stacking"](spark, "")
    assert list(stack.base) == ["enet", "svr", "forest", "xgb"] and stack.folds == 5 and stack.meta_alpha == en.META_ALPHAS
    assert stack.base["forest"].getNumTrees() == 200 and stack.base["xgb"].settings["rounds"] == 200


def test_segmented_model_routes_by_band(data):
    _, vec, _, _ = data
    out = en.SegmentedModel((45, 55), rounds=3, n_alphas=8).fit(vec).transform(vec)
    assert out.where("prediction is null").count() == 0
    assert {r["segment"] for r in out.select("segment").distinct().collect()} <= {0, 1, 2}


def test_neighbour_regression_weights_by_distance(spark):
    df = spark.createDataFrame([("a", 10.0, [0.0]), ("b", 20.0, [3.0]), ("c", 90.0, [50.0])], "sample_id STRING, label DOUBLE, features ARRAY<DOUBLE>")
    ask = spark.createDataFrame([("q", [1.0]), ("p", [3.0])], "sample_id STRING, features ARRAY<DOUBLE>")
    model = en.NeighbourRegressor(2).fit(df.withColumn("features", array_to_vector("features")))
    got = {r["sample_id"]: r["prediction"] for r in model.transform(ask.withColumn("features", array_to_vector("features"))).collect()}
    assert got["q"] == pytest.approx((10 / 1 + 20 / 2) / 1.5) and got["p"] == 20.0


def test_calibration_equals_fits_without_the_fold(spark):
    rng = np.random.default_rng(4)
    y = rng.uniform(20, 80, 40)
    p = 3 + 0.05 * y + rng.normal(0, 0.3, 40)
    rows = [(f"s{i}", "c", float(p[i]), float(y[i]), i % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "sample_id STRING, clock STRING, y_pred DOUBLE, y_true DOUBLE, fold INT")
    got = {r["sample_id"]: r["calibrated"] for r in ck.calibrate(df).collect()}
    for f in range(4):
        test = np.arange(40) % 4 == f
        a, b = np.polyfit(p[~test], y[~test], 1)
        for i in np.flatnonzero(test):
            assert got[f"s{i}"] == pytest.approx(a * p[i] + b)


def test_coefficient_table_orders_by_strength(spark):
    names = spark.createDataFrame([(1, "cg1"), (2, "cg2"), (3, "cg3")], "rank BIGINT, feature STRING")
    fit = ln.LinearFit(np.array([0.5, -2.0, 0.0]), 1.0)
    got = [tuple(r) for r in en.coefficient_table(fit, names, 2).collect()]
    assert got == [("cg2", -2.0, 2.0), ("cg1", 0.5, 0.5)]


def test_forest_works_in_few_tasks_unless_they_hold_too_much(spark, data, monkeypatch):
    """Each task sends the sums of all nodes: 16 partitions of a small table become a fifth of the cores, and every row stays."""
    seen, plain = [], RandomForestRegressor._fit
    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.count())) or plain(self, df))
    rows = data[1].select("sample_id", "label", "features").repartition(16)
    pred = en.forest(5, 3).fit(rows).transform(rows)
    assert pred.where("prediction is not null").count() == 120
    monkeypatch.setattr(en, "FOREST_BYTES", 120 * 4 * (6 + 5 + 16) // 10)
    en.forest(5, 3).fit(rows)
    assert seen == [(-(-spark.sparkContext.defaultParallelism // en.THREADS), 120), (10, 120)]
