import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cpgloom.operators import metrics as m
from cpgloom.operators import ordering as o
from cpgloom.operators.impute import neighbours


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value most of those."""
    rng = np.random.default_rng(3)
    n = 4000
    g = np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.9, "warm", "cold"))
    v = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(size=n), 2))
    pdf = pd.DataFrame({"g": g, "sample_id": np.arange(n), "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_row_numbers_match_a_plain_window(skewed):
    pdf, df = skewed
    got = o.numbered(df, ["g"], ["v", "sample_id"], "rn", "n").toPandas().sort_values("sample_id")
    ranked = pdf.sort_values(["g", "v", "sample_id"])
    want = ranked.groupby("g").cumcount() + 1
    assert (got["rn"].to_numpy() == want.sort_index().to_numpy()).all()
    sizes = pdf.groupby("g").size()
    assert (got["n"].to_numpy() == sizes[got["g"]].to_numpy()).all()


def test_row_numbers_without_groups_and_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g STRING, v INT")
    assert sorted(r["rn"] for r in o.numbered(df, [], ["v"]).collect()) == [1, 2, 3]
    by = {(r["g"], r["v"]): r["rn"] for r in o.numbered(df, ["g"], ["v"]).collect()}
    assert by == {(None, 1): 1, (None, 2): 2, ("a", 3): 1}


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = o.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 0.975, 1.0], list("abcde"), "n").toPandas()
    for _, r in got.iterrows():
        want = np.quantile(pdf.loc[pdf.g == r["g"], "v"], [0.0, 0.1, 0.5, 0.975, 1.0])
        assert np.allclose([r[c] for c in "abcde"], want)
    assert int(got["n"].sum()) == len(pdf)


@pytest.mark.parametrize("sketch", [20, 50])
def test_bracketed_quantiles_match_numpy(spark, skewed, monkeypatch, sketch):
    """A coarse sketch narrows the groups here as the real one does for large groups."""
    pdf, df = skewed
    monkeypatch.setattr(o, "SKETCH", sketch)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    seen = []
    place = o._positions
    monkeypatch.setattr(o, "_positions", lambda *a: seen.append(a[3]) or place(*a))
    for value in ("v", "w"):
        mixed = df.withColumn("w", F.col("v") + F.rand(1).cast("float") * 0)
        got = o.exact_quantiles(mixed, ["g"], value, probs, [f"q{i}" for i in range(7)]).toPandas()
        for _, r in got.iterrows():
            want = np.quantile(pdf.loc[pdf.g == r["g"], "v"], probs)
            assert np.allclose([r[f"q{i}"] for i in range(7)], want)
    assert True in seen


def test_missed_brackets_fall_back_to_the_whole_range(skewed, monkeypatch):
    pdf, df = skewed
    bad = lambda rows, keys, probs, narrow: rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.array(F.lit(-99.0) if narrow else F.min("_v")).alias("_lo"),
        F.array(F.lit(-98.0) if narrow else F.max("_v")).alias("_hi"),
    )
    monkeypatch.setattr(o, "_brackets", bad)
    got = {r["g"]: r["m"] for r in o.exact_quantiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert got == pytest.approx(pdf.groupby("g")["v"].median().to_dict())


@pytest.mark.parametrize("block", [10, 97, 100_000])
def test_frames_and_running_values_cross_blocks(skewed, block):
    pdf, df = skewed
    rows = o.numbered(df, ["g"], ["sample_id"])
    framed = o.framed(rows, ["g"], "rn", 3, 2, {"mean": lambda w: F.avg("v").over(w.rowsBetween(-3, 2)), "prev": lambda w: F.lag("v").over(w)}, block)
    plain = Window.partitionBy("g").orderBy("rn")
    want = rows.select("g", "rn", F.avg("v").over(plain.rowsBetween(-3, 2)).alias("mean"), F.lag("v").over(plain).alias("prev"))
    a = framed.select("g", "rn", "mean", "prev").toPandas().sort_values(["g", "rn"]).reset_index(drop=True)
    b = want.toPandas().sort_values(["g", "rn"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    for how, fn in (("sum", F.sum), ("min", F.min)):
        run = o.running(rows, ["g"], "rn", "v", "x", how, block).select("g", "rn", "x").toPandas().sort_values(["g", "rn"])
        ref = rows.select("g", "rn", fn("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("x")).toPandas().sort_values(["g", "rn"])
        assert np.allclose(run["x"], ref["x"])


def test_average_ranks_share_positions(skewed):
    pdf, df = skewed
    got = o.average_ranks(df, ["g"], "v", ["sample_id"], "rank").toPandas().sort_values("sample_id")
    want = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["rank"].to_numpy(), want.to_numpy())


def test_rolling_bands_match_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"model": "m", "sample_id": range(60), "y_true": rng.permutation(60) * 1.0})
    pdf["y_pred"] = pdf["y_true"] + rng.normal(size=60)
    got = m.rolling_bands(spark.createDataFrame(pdf)).toPandas().sort_values("rn")
    e = pdf.assign(e=pdf.y_pred - pdf.y_true).sort_values("y_true")["e"]
    roll = e.rolling(20, center=True, min_periods=5)
    assert np.allclose(got["mean"], roll.mean(), equal_nan=True)
    assert np.allclose(got["sd"], roll.std(), equal_nan=True)


def test_moving_average_matches_convolution(spark):
    rng = np.random.default_rng(6)
    for n in (57, 120):  # odd and even window
        pdf = pd.DataFrame({"model": "m", "sample_id": range(n), "y_true": 0.0, "y_pred": rng.normal(size=n)})
        got = m.moving_average(spark.createDataFrame(pdf)).toPandas().sort_values("rn")
        w = max(n // 10, 5)
        e = np.sort(pdf["y_pred"].to_numpy())
        want = np.convolve(e, np.ones(w) / w, mode="valid")
        assert np.allclose(got["smoothed"], want)
        assert got["rn"].iloc[0] == w // 2 + 1


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 5))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(f"s{i:02d}", [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "sample_id STRING, features ARRAY<DOUBLE>")
    got = neighbours(df, df, 3, block=7).toPandas()
    for i in range(40):
        d = []
        for j in range(40):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if i != j and both.any():
                d.append((round(float(np.sqrt(5 / both.sum() * np.sum((x[i][both] - x[j][both]) ** 2))), 10), f"s{j:02d}"))
        want = [b for _, b in sorted(d)[:3]]
        mine = got[got.sample_id == f"s{i:02d}"].sort_values("rank")["donor_id"].tolist()
        assert mine == want
