"""Principal components against NumPy's decomposition, on both layouts."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cpgloom.operators import components as pc


def matrix(n, p, seed=2, fall=0.8, rank=None):
    rng = np.random.default_rng(seed)
    r = rank or min(n, p)
    u, v = np.linalg.qr(rng.normal(size=(n, r)))[0], np.linalg.qr(rng.normal(size=(p, r)))[0]
    return u * (10 * fall ** np.arange(r)) @ v.T + rng.normal(size=p)


def tables(spark, x):
    rows = [(f"s{i:04d}", 0.0, [float(v) for v in r]) for i, r in enumerate(x)]
    rows = spark.createDataFrame(rows, "sample_id STRING, label DOUBLE, features ARRAY<DOUBLE>").repartition(5)
    return rows, rows.select("sample_id", F.posexplode("features").alias("feature", "z"))


def near(a, b):
    """Equal columns, up to their signs."""
    return np.allclose(np.abs((a * b).sum(0)), np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0), rtol=1e-9)


@pytest.mark.parametrize("k, wide", [(6, 0), (6, 1024), (200, 1024)])
def test_few_samples_many_probes(spark, monkeypatch, k, wide):
    monkeypatch.setattr(pc, "EXTRA", 10)
    monkeypatch.setattr(pc, "LIST", 9)
    x = matrix(40, 500, fall=0.8 if wide == 0 else 0.9)
    rows, cells = tables(spark, x)
    got = pc.of_cells(cells, rows.drop("features"), k, wide=wide)
    assert (got.found.turns > 1) == (wide == 0)
    mean = x.mean(0)
    u, s, v = np.linalg.svd(x - mean, full_matrices=False)
    k = min(k, 39)
    assert got.found.gap <= 1e-10 and got.found.values.shape == (k,)
    assert np.allclose(got.found.values, s[:k], rtol=1e-8)
    assert near(got.scores, u[:, :k] * s[:k])
    axes = np.array([r["axis"] for r in got.axes.orderBy("feature").collect()])
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-8) and near(axes, v[:k].T)
    assert got.found.share.sum() == pytest.approx((s[:k] ** 2).sum() / (s**2).sum())
    back = {r["sample_id"]: r["pc"] for r in pc.project_cells(cells, got.axes).collect()}
    assert np.allclose([back[i] for i in got.samples], got.scores, atol=1e-9)
    # New samples: a missing value counts as the mean, an unknown feature not at all.
    new = spark.createDataFrame([("n", 0, float(x[3, 0])), ("n", 1, None), ("n", 9999, 5.0)], "sample_id STRING, feature BIGINT, z DOUBLE")
    assert np.allclose(pc.project_cells(new, got.axes).first()["pc"], (x[3, 0] - mean[0]) * axes[0], atol=1e-9)


def test_few_features_many_samples(spark):
    x = matrix(700, 30)
    rows, _ = tables(spark, x)
    rows = rows.withColumn("features", array_to_vector("features")).withColumn("pc", F.lit(1))
    found, mean = pc.of_rows(rows, 5)
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(found.values, s[:5], rtol=1e-8) and near(found.vectors, v[:5].T)
    got = {r["sample_id"]: r["pc"] for r in pc.project_rows(rows, found, mean).collect()}
    assert np.allclose([got[f"s{i:04d}"] for i in range(700)], (x - x.mean(0)) @ found.vectors)


def test_rank_and_tables_without_spread(spark):
    x = matrix(50, 80, rank=4)
    rows, cells = tables(spark, x)
    assert len(pc.of_cells(cells, rows.drop("features"), 20).found.values) == 4
    rows, cells = tables(spark, np.ones((6, 9)))
    got = pc.of_cells(cells, rows.drop("features"), 3)
    assert got.found.values.shape == (0,) and got.scores.shape == (6, 0) and got.axes.count() == 9
    found, mean = pc.of_rows(rows.limit(0).withColumn("features", array_to_vector("features")), 3)
    assert found.values.shape == (0,) and mean.shape == (0,)


def test_small_values_keep_their_digits(spark):
    """Squared sums would lose values below 1e-8 of the largest."""
    x = matrix(400, 6, fall=0.02)
    rows, _ = tables(spark, x)
    found, _mean = pc.of_rows(rows.withColumn("features", array_to_vector("features")), 6)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert s[5] < 1e-8 * s[0] and np.allclose(found.values, s, rtol=1e-5)


def test_qr_tree_over_many_tasks(spark):
    x = np.random.default_rng(1).normal(size=(300, 7))
    table = spark.createDataFrame([([float(v) for v in r],) for r in x], "x ARRAY<DOUBLE>").repartition(70)
    r = pc.tall_r(table, 7, np.eye(7), np.zeros(7))
    assert r.shape == (7, 7) and np.allclose(r.T @ r, x.T @ x)


def test_bounds_are_checked(spark):
    table = spark.createDataFrame([([1.0, None],)], "x ARRAY<DOUBLE>")
    with pytest.raises(ValueError, match="exceed"):
        pc.principal(table, 10_000_000, 10)
    with pytest.raises(Exception, match="impute first"):
        pc.principal(table, 2, 1)
