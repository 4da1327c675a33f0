"""Wide designs: the sample-space solver against closed forms, the primal path and optimality conditions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.operators import linear as ln
from cpgloom.operators import sample_space as ss


def design(spark, n, p, seed=4, folds=3, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, p // 2] = 0.0  # a feature without spread
    w = np.zeros(p)
    w[:5] = [4.0, -3.0, 2.0, 1.0, -1.0]
    y = 40 + x @ w + rng.normal(0, noise, n)
    rows = [(f"s{i:04d}", float(y[i]), i % folds, [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id STRING, label DOUBLE, fold INT, features ARRAY<DOUBLE>").repartition(4)
    return df, x, y, np.arange(n) % folds


def columns(spark, x):
    return spark.createDataFrame([(j, [float(v) for v in x[:, j]]) for j in range(x.shape[1])], "feature BIGINT, x ARRAY<DOUBLE>").repartition(5)


def gaps(x, y, fit):
    """How far each feature is from its optimality condition."""
    r = y - x @ fit.coef - fit.intercept
    pull = x.T @ r / len(y) - fit.alpha * (1 - fit.rho) * fit.coef
    l1 = fit.alpha * fit.rho
    return np.where(fit.coef == 0, np.maximum(np.abs(pull) - l1, 0), np.abs(pull - l1 * np.sign(fit.coef))).max(), abs(r.mean())


@pytest.mark.parametrize("alpha, rho", [(0.5, 0.5), (0.01, 0.1), (0.05, 0.9), (0.2, 1.0), (0.001, 0.5), (1e6, 0.5)])
@pytest.mark.parametrize("shape", [(60, 20), (30, 200)])
def test_newton_reaches_the_optimum(shape, alpha, rho):
    rng = np.random.default_rng(1)
    x = rng.normal(size=shape)
    y = x[:, 0] * 3 - x[:, 1] + rng.normal(0, 0.3, shape[0])
    x, y = x - x.mean(0), y - y.mean()
    _, w = ss.newton(x, y, alpha, rho)
    gap, _ = gaps(x, y, ln.LinearFit(w, 0.0, alpha, rho))
    assert gap < 1e-8
    if alpha > 1000:
        assert not w.any()


@pytest.mark.parametrize("alpha, rho, without", [(0.3, 0.5, None), (0.05, 0.9, 1), (0.1, 0.1, 0)])
def test_equal_to_the_primal_path_at_a_common_width(spark, alpha, rho, without):
    df, x, y, fold = design(spark, 90, 24)
    primal = ln.FoldSums(df).fit(alpha, rho, without=without)
    dual = ss.SampleSpace.from_rows(df).fit(alpha, rho, without=without)
    assert np.allclose(primal.coef, dual.coef, atol=1e-6) and abs(primal.intercept - dual.intercept) < 1e-6


def test_tuning_at_the_seam(spark):
    df, *_ = design(spark, 90, 24)
    primal, dual = ln.FoldSums(df).tune([0.3, 0.8], 12), ss.SampleSpace.from_rows(df).tune([0.3, 0.8], 12)
    assert (primal.rho, pytest.approx(primal.alpha)) == (dual.rho, dual.alpha)
    assert np.allclose(primal.coef, dual.coef, atol=1e-6)


def test_ridge_and_its_errors(spark):
    df, x, y, fold = design(spark, 40, 150)
    space = ss.SampleSpace.from_rows(df)
    assert np.allclose(space.gram(), x @ x.T)
    err = np.zeros(2)
    for i, alpha in enumerate([1.0, 30.0]):
        for f in (None, 0, 1, 2):
            train = fold != (-1 if f is None else f)
            xc, yc = x[train] - x[train].mean(0), y[train] - y[train].mean()
            w = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(train.sum()), yc)
            fit = space.ridge(alpha, f)
            assert np.allclose(fit.coef, w) and np.isclose(fit.intercept, y[train].mean() - x[train].mean(0) @ w)
            if f is not None:
                err[i] += ((x[~train] @ w + fit.intercept - y[~train]) ** 2).mean() / 3
    assert np.allclose(space.ridge_errors([1.0, 30.0]), err)
    assert np.allclose(space.fit(1.0, None, range(10)).coef[10:], 0)


def test_a_small_working_set_reaches_the_same_optimum(spark, monkeypatch):
    df, x, y, _ = design(spark, 50, 300)
    space = ss.SampleSpace.from_rows(df)
    whole = space.fit(0.02, 0.5)
    monkeypatch.setattr(ss, "FIRST", 4)  # grows by doubling
    grown = space.fit(0.02, 0.5)
    assert np.allclose(whole.coef, grown.coef, atol=1e-7)
    assert max(gaps(x, y, grown)) < 1e-6
    monkeypatch.setattr(ss, "MAX_WORKING", 50 * 8 * 10)
    with pytest.raises(ValueError, match="active at once"):
        space.fit(0.02, 0.5)


def test_ten_thousand_features(spark):
    rng = np.random.default_rng(8)
    n, p = 120, 10_000
    x = rng.normal(size=(n, p))
    y = 50 + x[:, :10] @ np.linspace(5, 1, 10) + rng.normal(0, 1, n)
    space = ss.SampleSpace(columns(spark, x), [str(i) for i in range(n)], y, np.arange(n) % 3)
    fit = space.tune([0.5, 0.9], 10)
    assert max(gaps(x, y, fit)) < 1e-6
    assert set(np.flatnonzero(np.abs(fit.coef) > 1)) <= set(range(10)) and fit.coef[0] > 2


def test_searches_run_on_either_side(spark):
    df, x, y, fold = design(spark, 60, 16)
    sums, space = ln.FoldSums(df), ss.SampleSpace.from_rows(df)
    for search in (
        lambda s: ln.k_sweep(s, [4, 16]).orderBy("k"),
        lambda s: ln.eliminate(s, 6, 4)[0].orderBy("n_features"),
        lambda s: ln.random_search(s, 4).orderBy("trial"),
    ):
        a, b = search(sums).toPandas(), search(space).toPandas()
        assert list(a["n"]) == list(b["n"])
        assert np.allclose(a["mae"], b["mae"], atol=1e-5) and np.allclose(a["r2"], b["r2"], atol=1e-5)
    ridge = {"all": (2.0, None, None), "some": (2.0, None, range(5))}
    assert np.allclose(*[s.score(ridge).orderBy("name").toPandas()["mae"] for s in (sums, space)])


def test_choice_by_shape(spark):
    wide, tall = design(spark, 20, 50)[0], design(spark, 50, 20)[0]
    assert isinstance(ln.design_sums(wide), ss.SampleSpace) and isinstance(ln.design_sums(tall), ln.FoldSums)


def test_cells_predictions_and_optimality(spark):
    df, x, y, _ = design(spark, 30, 60)
    cells = df.select("sample_id", F.posexplode("features").alias("feature", "z"))
    space = ss.SampleSpace.from_cells(cells, df.select("sample_id", "label", "fold"))
    fit = space.fit(0.1, 0.5)
    got = {r.sample_id: r.prediction for r in ss.predict_cells(cells, fit).collect()}
    assert np.allclose([got[f"s{i:04d}"] for i in range(30)], x @ fit.coef + fit.intercept)
    worst = ss.optimality(cells, df, fit).agg(F.max("gap"), F.count("*")).first()
    assert worst[0] < 1e-6 and worst[1] == 60
    with pytest.raises(Exception, match="impute first"):
        ss.SampleSpace.from_cells(cells.where("not (feature = 3 and sample_id = 's0001')"), df).width  # noqa: B018


def test_refuses_too_many_samples(spark, monkeypatch):
    monkeypatch.setattr(ss, "MAX_SAMPLES", 10)
    with pytest.raises(ValueError, match="samples"):
        ss.SampleSpace.from_rows(design(spark, 12, 6)[0])
