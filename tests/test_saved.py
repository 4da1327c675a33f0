"""Saved models and pipelines score alike after loading in a fresh object."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from cpgloom.functions.scalars import age_to_clock, clock_to_age
from cpgloom.operators import ensembles as en
from cpgloom.operators import linear as ln
from cpgloom.operators import saved
from cpgloom.operators.preparation import PreparedProbes, ProbePreparation


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 5))
    y = 50 + 9 * x[:, 0] - 4 * x[:, 1] + rng.normal(0, 1, 80)
    data = [(f"s{i:03d}", float(y[i]), [float(v) for v in x[i]]) for i in range(80)]
    return spark.createDataFrame(data, "sample_id STRING, label DOUBLE, features ARRAY<DOUBLE>").withColumn("features", array_to_vector("features")).cache()


@pytest.fixture(scope="module")
def raw(spark):
    """Raw cells with gaps: null values and missing rows."""
    rng = np.random.default_rng(7)
    out = []
    for i in range(60):
        age = 20.0 + i
        for p in range(12):
            beta = None if (i + p) % 9 == 0 or p == 11 else float(age / 100 * (p + 1) / 12 + rng.normal(0, 0.02))
            if not (i == 5 and p == 3):
                out.append((f"s{i:02d}", p, beta, age))
    return spark.createDataFrame(out, "sample_id STRING, probe_ord BIGINT, beta DOUBLE, age DOUBLE").cache()


MODELS = {
    "tuned": lambda: en.TunedElasticNet(n_alphas=5),
    "neighbours": lambda: en.NeighbourRegressor(3),
    "residual": lambda: en.ResidualLearner(rounds=3, n_alphas=5),
    "stack": lambda: en.Stacking({"ridge": ln.ridge(1.0), "knn": en.NeighbourRegressor(3)}, passthrough=True),
    "bands": lambda: en.BandCorrection(ln.elastic_net(0.1, 0.5), bands=(0, 50, 120)),
    "bands, none large enough": lambda: en.BandCorrection(ln.ridge(1.0), smallest=1000),
    "segments": lambda: en.SegmentedModel(edges=(50,), rounds=2, n_alphas=5),
    "target": lambda: en.TransformedTarget(ln.ridge(1.0), age_to_clock, clock_to_age),
    "spline": lambda: en.SplineRidge(2),
    "fourier": lambda: en.FourierRidge(20),
}


def scores(model, df):
    return [tuple(r) for r in model.transform(df).select("sample_id", "prediction").orderBy("sample_id").collect()]


@pytest.mark.parametrize("name", list(MODELS))
def test_models_come_back(rows, tmp_path, name):
    model = MODELS[name]().fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert again is not model and again.uid == model.uid
    assert scores(again, rows) == scores(model, rows)


def test_estimators_come_back(rows, tmp_path):
    est = en.TunedElasticNet([0.3], 4, 2, 9)
    est.save(str(tmp_path / "e"))
    again = en.TunedElasticNet.load(str(tmp_path / "e"))
    assert (again.ratios, again.n_alphas, again.folds, again.seed) == ([0.3], 4, 2, 9)


@pytest.mark.parametrize("fill", ["zero", "mean", "median"])
def test_preparation_equals_plain_numbers(raw, fill):
    train = raw.where("age < 60")
    model = ProbePreparation(k=12, fill=fill).fit(train)
    got = {r.sample_id: r for r in model.transform(raw).withColumn("features", vector_to_array("features")).collect()}
    order = [r.probe_ord for r in model.table.orderBy("rank").collect()]
    pdf = raw.toPandas()
    wide = pdf.pivot(index="sample_id", columns="probe_ord", values="beta")
    seen = train.toPandas().pivot(index="sample_id", columns="probe_ord", values="beta")
    for j, p in enumerate(order):
        col = seen[p]
        if p == 3:
            col = col.drop("s05")  # that row does not exist
        value = {"zero": 0.0, "mean": col.mean(), "median": col.median()}[fill]
        value = 0.0 if np.isnan(value) else value
        filled = col.fillna(value)
        sd = filled.std(ddof=0)
        sd = sd if sd > 1e-13 else 1.0
        for s in ("s00", "s05", "s30", "s59"):
            x = wide.loc[s, p]
            want = ((value if np.isnan(x) else x) - filled.mean()) / sd
            assert got[s].features[j] == pytest.approx(want, abs=1e-9)
    assert got["s05"].label == 25.0


@pytest.mark.parametrize("inner", ["tuned", "forest", "residual"])
def test_a_pipeline_scores_raw_cells_after_loading(raw, tmp_path, inner):
    last = {"tuned": lambda: en.TunedElasticNet(n_alphas=5), "forest": lambda: en.forest(5, 4), "residual": lambda: en.ResidualLearner(rounds=2, n_alphas=4)}[inner]()
    model = Pipeline(stages=[ProbePreparation(k=6), last]).fit(raw.where("age < 60"))
    model.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert isinstance(again.stages[0], PreparedProbes)
    unseen = raw.where("age >= 60").drop("age")
    assert scores(again, unseen) == scores(model, unseen) and len(scores(again, unseen)) == 20
    if inner == "forest":
        assert isinstance(again.stages[1], RandomForestRegressionModel)


def test_only_known_modules_are_loaded():
    with pytest.raises(ValueError, match="may name"):
        saved._named("os:system")


def test_unknown_fill():
    with pytest.raises(ValueError, match="zero, mean, median"):
        ProbePreparation(fill="mode")


def test_two_stage_choice(raw):
    model = ProbePreparation(k=3, n_var=5).fit(raw)
    assert model.table.count() == 3
    assert model.transform(raw).where(F.size(vector_to_array("features")) != 3).count() == 0
