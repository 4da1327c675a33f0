"""Penalised splines against dense algebra, straight lines and their own optimality."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cpgloom.operators import splines as sp


def frame(spark, x, y):
    rows = [(i, [float(v) for v in row], None if t is None else float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id INT, f ARRAY<DOUBLE>, label DOUBLE").select("id", "label", array_to_vector("f").alias("features"))


def predictions(model, df):
    return [r["prediction"] for r in model.transform(df).orderBy("id").collect()]


@pytest.fixture(scope="module")
def curved():
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 3, (300, 3))
    y = np.sin(2 * x[:, 0]) * 4 + x[:, 1] ** 2 + rng.normal(0, 0.3, 300)
    return x, y


def recursive(x, knots, j, degree):
    """B-spline value by its recurrence."""
    if degree == 0:
        return ((knots[j] <= x) & (x < knots[j + 1])).astype(float)
    a = (x - knots[j]) / (knots[j + degree] - knots[j]) * recursive(x, knots, j, degree - 1)
    b = (knots[j + degree + 1] - x) / (knots[j + degree + 1] - knots[j + 1]) * recursive(x, knots, j + 1, degree - 1)
    return a + b


def test_basis_equals_the_recurrence():
    x = np.linspace(0, 5, 51)[:-1]
    got = sp.basis(x[:, None], np.array([0.0]), np.array([1.0]), 5)
    knots = np.arange(-3, 9.0)
    want = np.stack([recursive(x, knots, j, 3) for j in range(8)], axis=1)
    assert np.allclose(got, want) and np.allclose(got.sum(1), 1)
    assert np.allclose(sp.basis(np.array([[5.0]]), np.array([0.0]), np.array([1.0]), 5)[0, 5:], [1 / 6, 4 / 6, 1 / 6])


def test_fit_equals_dense_solution_and_search(spark, curved):
    x, y = curved
    df = frame(spark, x, y).repartition(5)
    model = sp.PenalisedSplines(segments=8).fit(df)
    low, step = x.min(0), (x.max(0) - x.min(0)) / 8
    z = sp.basis(x, low, step, 8)
    best = None
    for strength, edf, rss, gcv in model.grid:
        # Unpenalised intercept beside the columns, smallest solution of the least squares with added rows.
        d = np.kron(np.eye(3), np.diff(np.eye(11), 2, axis=0)) * np.sqrt(strength)
        tall = np.vstack([np.hstack([np.ones((300, 1)), z]), np.hstack([np.zeros((len(d), 1)), d])])
        w = np.linalg.lstsq(tall, np.append(y, np.zeros(len(d))), rcond=1e-10)[0]
        fitted = w[0] + z @ w[1:]
        hat = (np.linalg.pinv(tall, rcond=1e-10)[:, :300] * np.hstack([np.ones((300, 1)), z]).T).sum()
        assert edf == pytest.approx(hat, rel=1e-6) and rss == pytest.approx(((y - fitted) ** 2).sum(), rel=1e-6)
        assert gcv == pytest.approx(300 * rss / (300 - sp.COST * edf) ** 2)
        if best is None or gcv < best[0]:
            best = (gcv, strength, fitted)
    assert model.strength == best[1]
    assert np.allclose(predictions(model, df), best[2], atol=1e-6)
    assert 0 < model.gaps(df).agg(F.count("*").alias("n")).first()["n"] == 33
    assert model.gaps(df).agg(F.max("gap").alias("g")).first()["g"] < 1e-6
    chosen = model.trials(df).where("chosen").collect()
    assert len(chosen) == 1 and chosen[0]["gcv"] == best[0]


def test_strong_penalty_is_a_straight_line_and_goes_on_as_one(spark):
    x = np.linspace(0, 1, 40)[:, None]
    y = 3 * x[:, 0] + np.sin(40 * x[:, 0]) * 0.01
    model = sp.PenalisedSplines(strengths=[1e9]).fit(frame(spark, x, y))
    slope, start = np.polyfit(x[:, 0], y, 1)
    far = frame(spark, [[-2.0], [0.5], [7.0]], [None] * 3)
    assert np.allclose(predictions(model, far), [start - 2 * slope, start + slope / 2, start + 7 * slope], atol=1e-5)


def test_tangents_join_smoothly(spark, curved):
    x, y = curved
    model = sp.PenalisedSplines(segments=8).fit(frame(spark, x, y))
    top, h = x[:, 0].max(), 1e-5
    at = [[top + d, 0.0, 0.0] for d in (-h, 0.0, h, 1.0)]
    a, b, c, d = predictions(model, frame(spark, at, [None] * 4))
    assert (c - b) / h == pytest.approx((b - a) / h, abs=1e-2) and d - b == pytest.approx((c - b) / h, abs=1e-3)


def test_constant_repeated_null_and_missing(spark, curved):
    x, y = curved
    flat = np.column_stack([x[:, 0], x[:, 0], np.full(300, 7.0)])
    labels = [None if i % 10 == 0 else v for i, v in enumerate(y)]
    df = frame(spark, flat, labels)
    model = sp.PenalisedSplines(segments=6).fit(df)
    got = predictions(model, df)
    one = sp.PenalisedSplines(segments=6, strengths=[model.strength / 2]).fit(frame(spark, flat[:, :1], labels))
    # Two equal features share the curve, so together they bear half the penalty.
    assert np.allclose(got, predictions(one, frame(spark, flat[:, :1], labels)), atol=1e-5)
    odd = frame(spark, [[float("nan"), 0.0, 7.0], [0.0, float("inf"), 7.0], [0.0, 0.0, 9.0]], [1.0, None, None])
    assert [p is None for p in predictions(model, odd)] == [True, True, False]


def test_refusals(spark, curved):
    x, y = curved
    with pytest.raises(ValueError, match="no row"):
        sp.PenalisedSplines().fit(frame(spark, x[:3], [None] * 3))
    with pytest.raises(ValueError, match="select first"):
        sp.PenalisedSplines(segments=997).fit(frame(spark, np.zeros((2, 4)), [1.0, 2.0]))


def test_saved_curves_score_alike(spark, curved, tmp_path):
    x, y = curved
    df = frame(spark, x, y)
    model = sp.PenalisedSplines(segments=5).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = sp.SplineCurves.load(str(tmp_path / "m"))
    assert predictions(again, df) == predictions(model, df) and again.grid == model.grid
