"""Wide designs of more samples than a sample space takes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cpgloom.operators import components as pc
from cpgloom.operators import linear as ln
from cpgloom.operators import sample_space as ss
from cpgloom.plans import catalog, wide_queries


def design(spark, n=90, p=14, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 3] = 0.0  # a feature without spread
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) + 40
    rows = [(f"s{i:04d}", float(y[i]), i % 3, x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id STRING, label DOUBLE, fold INT, features ARRAY<DOUBLE>").repartition(3), x, y


@pytest.fixture
def few(monkeypatch):
    """A sample space takes 40 samples, and designs of over 10 features are wide."""
    monkeypatch.setattr(ss, "MAX_SAMPLES", 40)
    monkeypatch.setattr(ss, "FIRST", 10)


def test_cross_products_reach_the_optimum_of_the_sample_space(spark, monkeypatch):
    df, *_ = design(spark)
    space = ss.SampleSpace.from_rows(df)
    tuned, scores = space.tune([0.3, 0.8], 8), space.score({"a": (0.1, 0.5, None), "b": (0.05, 0.9, range(6)), "r": (3.0, None, None)}).orderBy("name").collect()
    monkeypatch.setattr(ss, "MAX_SAMPLES", 40)
    monkeypatch.setattr(ss, "FIRST", 10)
    sums = ln.design_sums(df)
    assert isinstance(sums, ss.DualSums)
    again = sums.tune([0.3, 0.8], 8)
    assert (again.alpha, again.rho) == (pytest.approx(tuned.alpha), tuned.rho)
    assert np.allclose(again.coef, tuned.coef, atol=1e-8) and again.intercept == pytest.approx(tuned.intercept)
    back = sums.score({"a": (0.1, 0.5, None), "b": (0.05, 0.9, range(6)), "r": (3.0, None, None)}).orderBy("name").collect()
    assert [r["n"] for r in back] == [90] * 3
    assert np.allclose([(r["mae"], r["r2"]) for r in back], [(r["mae"], r["r2"]) for r in scores], atol=1e-7)
    cells = df.select("sample_id", F.posexplode("features").alias("feature", "z"))
    for fit in (sums.fit(0.02, 0.5), sums.fit(0.3, 1.0)):
        assert ss.optimality(cells, df, fit).agg(F.max("gap")).first()[0] < 1e-8


@pytest.mark.parametrize("k", [4, None])
def test_components_of_many_samples(spark, few, k):
    df, x, _ = design(spark)
    found, axes, scores = pc.of_design(df, k)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    k = k or 13  # one feature has no spread
    assert np.allclose(found.values, s[:k]) and axes.count() == 14
    got = {r["sample_id"]: r["pc"] for r in scores(df).collect()}
    made, told = np.array([got[f"s{i:04d}"] for i in range(90)]), (x - x.mean(0)) @ v[:k].T
    assert np.allclose(np.abs(made), np.abs(told), atol=1e-8)


@pytest.mark.parametrize(
    "name",
    ["m01_wide_ridge", "m02_wide_elastic_net", "m11_wide_elimination", "m12_wide_feature_sweep", "m20_component_predictions", "m20_component_ridge",
     "m20_wide_components", "m21_wide_random_search", "w07_wide_cumulative_variance"],
)
def test_wide_queries_take_many_samples(spark, few, monkeypatch, name):
    df, *_ = design(spark, p=5)
    split = F.when(F.col("fold") == 0, "test").otherwise("train")
    rows = df.select("sample_id", "label", split.alias("split"), array_to_vector("features").alias("features"))
    monkeypatch.setattr(wide_queries, "split_design", lambda *_: rows)
    got = catalog.QUERIES[name](spark, "").collect()
    assert got
    for r in got:
        told = r.asDict()
        assert all(told[c] == 0 for c in ("n_broken", "n_off", "n_not_orthonormal", "n_wrong_variance", "n_correlated") if c in told)
