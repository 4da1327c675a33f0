import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.functions import distributions as d
from cpgloom.functions import scalars as sc
from cpgloom.operators import metrics as m


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["DOUBLE"] * len(values))))
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "t, df, p",
    [(2.7764451051977987, 4, 0.05), (12.706204736432095, 1, 0.05), (2.0422724563012373, 30, 0.05), (0.0, 7, 1.0), (4.604094871349993, 4, 0.01)],
)
def test_t_tail(t, df, p):
    assert d.t_two_sided(t, df) == pytest.approx(p, abs=1e-9)
    assert d.t_two_sided(-t, df) == pytest.approx(p, abs=1e-9)


def test_t_table_agrees_with_tail():
    for df, t in enumerate(d.T_975, start=1):
        assert d.t_two_sided(t, df) == pytest.approx(0.05, abs=1e-9)


def test_t_point_beyond_the_table(spark):
    got = spark.range(1).select(d.t_975(F.lit(60)).alias("x"), d.t_975(F.lit(4)).alias("y")).first()
    assert got["x"] == pytest.approx(2.0002978, abs=1e-5)
    assert got["y"] == 2.7764451051977987


def test_normal_quantile_over_the_whole_range(spark):
    from statistics import NormalDist

    at = [1e-300, 1e-20, 1e-9, 1e-4, 0.02, 0.0749, 0.0751, 0.3, 0.5, 0.6, 0.9249, 0.9251, 0.99, 1 - 1e-12]
    got = spark.createDataFrame([(p,) for p in at], "p DOUBLE").select("p", d.normal_quantile("p").alias("z")).collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-13, abs=1e-15) for r in got)
    odd = spark.createDataFrame([(0.0,), (1.0,), (-1.0,), (2.0,), (None,), (float("nan"),)], "p DOUBLE")
    assert [r["z"] for r in odd.select(d.normal_quantile("p").alias("z")).collect()] == [None] * 6


def test_normal_quantile(spark):
    got = spark.createDataFrame([(0.5,), (0.975,)], "p DOUBLE").select(d.normal_quantile("p").alias("z")).collect()
    assert [r["z"] for r in got] == pytest.approx([0.0, 1.959963984540054])


def test_m_values_clip_and_keep_null(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (None,)], "b DOUBLE")
    got = [r["m"] for r in df.select(sc.m_value("b").alias("m")).collect()]
    edge = math.log2(1e-6 / (1 - 1e-6))
    assert got[0] == 0.0 and got[3] is None
    assert got[1] == pytest.approx(edge) and got[2] == pytest.approx(-edge)


def test_age_scale_round_trip(spark):
    df = spark.createDataFrame([(float(a),) for a in (0, 5, 20, 21, 80)], "a DOUBLE")
    got = df.select("a", sc.clock_to_age(sc.age_to_clock("a")).alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"]) for r in got)


def test_bins_follow_their_closed_side(spark):
    df = spark.createDataFrame([(0.0,), (30.0,), (30.1,), (50.0,), (51.0,), (None,)], "x DOUBLE")
    right = [r["x"] for r in df.select(sc.bin_by("x", [0, 30, 50], ["a", "b"]).alias("x")).collect()]
    left = [r["x"] for r in df.select(sc.bin_by("x", [0, 30, 50], ["a", "b"], closed="left").alias("x")).collect()]
    low = [r["x"] for r in df.select(sc.bin_by("x", [0, 30, 50], ["a", "b"], include_lowest=True).alias("x")).collect()]
    assert right == [None, "a", "b", "b", None, None]
    assert left == ["a", "b", "b", None, None, None]
    assert low == ["a", "a", "b", "b", None, None]
    with pytest.raises(ValueError):
        sc.bin_by("x", [0, 1], ["a", "b"])


def test_boolean_spellings(spark):
    df = spark.createDataFrame([("True",), ("FALSE",), ("1",), ("0.0",), ("yes",), (None,)], "s STRING")
    assert [r["b"] for r in df.select(sc.parse_bool("s").alias("b")).collect()] == [True, False, True, False, None, None]


def test_prefixes_and_chip(spark):
    df = spark.createDataFrame([("1. Ridge", "201_R03"), ("Ridge v2. tuned", "77")], "a STRING, c STRING")
    got = df.select(sc.strip_number_prefix("a").alias("p"), sc.after_first_dot("a").alias("q"), sc.chip_id("c").alias("chip")).collect()
    assert [tuple(r) for r in got] == [("Ridge", "Ridge", "201"), ("Ridge v2. tuned", "tuned", "77")]


def test_grid_pads_and_polynomial_orders_terms(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v ARRAY<DOUBLE>")
    r = df.select(sc.pad_to_grid("v", 2, 3).alias("g"), sc.polynomial2("v").alias("p")).first()
    assert r["g"] == [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]]
    assert r["p"] == [1, 2, 3, 1, 2, 3, 4, 6, 9]


def preds(spark, y, p, model="a"):
    rows = [(model, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "model STRING, sample_id BIGINT, y_true DOUBLE, y_pred DOUBLE")


def test_metrics_of_constant_truth_do_not_fail(spark):
    r = m.error_metrics(preds(spark, [5, 5, 5], [4, 5, 7])).first()
    assert (r["r2"], r["correlation"], r["mad"]) == (0.0, 0.0, 1.0)
    assert r["mae"] == pytest.approx(1.0)


def test_paired_t_and_wilcoxon_by_hand(spark):
    diffs = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate([1, -2, 3, 0, 3])], "model STRING, sample_id BIGINT, diff DOUBLE")
    t = m.paired_t(diffs).first()
    x = np.array([1, -2, 3, 0, 3.0])
    assert t["t"] == pytest.approx(x.mean() / (x.std(ddof=1) / np.sqrt(5)))
    w = m.wilcoxon(diffs).first()
    assert (w["n"], w["w_plus"], w["w_minus"], w["w"]) == (4, 8.0, 2.0, 2.0)


def test_p_values_present(spark):
    a = preds(spark, [1, 2, 3, 4], [1, 2, 3, 5], "a").unionByName(preds(spark, [1, 2, 3, 4], [2, 4, 3, 8], "b"))
    assert m.best_model(a) == "a"
    r = m.paired_t(m.paired_errors(a, "a")).first()
    assert 0 < r["p"] < 1 and r["significant"] is False


def test_durbin_watson_and_segments_by_hand(spark):
    e = np.array([1.0, -1.0, 2.0, 0.5])
    r = m.durbin_watson(preds(spark, np.zeros(4), e)).first()
    assert r["durbin_watson"] == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e**2))
    n = 23
    y, p = np.arange(n) * 1.0, np.arange(n) * 1.5
    got = {r["segment"]: r["mean_abs"] for r in m.segment_acceleration(preds(spark, y, p)).collect()}
    a = np.abs(p - y)
    assert got == pytest.approx({i: a[int(i * n / 50) : int((i + 1) * n / 50) + 1].mean() for i in range(50)})


def test_two_group_test_needs_values(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0), ("y", 7.0)], "g STRING, v DOUBLE")
    r = m.two_sample_t(df, "v", "g", "x", "y").first()
    assert r["t"] == pytest.approx((1.5 - 6) / np.sqrt((0.5 + 2.0) / 2 * 1.0))
    assert r["stars"] in ("ns", "*")


def test_t_of_many_degrees_of_freedom_nears_the_normal():
    assert d.t_two_sided(1.96, 1e12) == pytest.approx(d.normal_two_sided(1.96), rel=1e-9)
    assert d.t_two_sided(1.96, 1.0001e7) == pytest.approx(d.t_two_sided(1.96, 0.9999e7), rel=1e-6)
