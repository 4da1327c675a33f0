"""The ways beyond the broadcast bound and the block sizes give the same results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cpgloom.operators import metrics as m
from cpgloom.operators import ordering, sizing
from cpgloom.operators import strata as st
from cpgloom.operators.impute import impute
from cpgloom.operators.probe_stats import missing_rate_filter


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(9)
    n = 1500
    y = np.round(rng.uniform(20, 80, n), 1)
    pdf = pd.DataFrame(
        {
            "model": np.where(np.arange(n) % 10 < 7, "big", np.where(np.arange(n) % 10 < 9, "mid", "small")),
            "sample_id": np.arange(n),
            "y_true": y,
            "y_pred": y + np.round(rng.normal(0, 4, n), 1),
        }
    )
    return spark.createDataFrame(pdf).repartition(5).cache()


OPERATORS = {
    "curve": m.calibration_curve,
    "spearman": m.spearman,
    "agreement": m.bland_altman,
    "smoothed": m.moving_average,
    "bands": m.rolling_bands,
    "durbin": m.durbin_watson,
    "kde": lambda p: st.kde(p.withColumn("e", m.err()), "e", "model", 20),
    "boxes": lambda p: st.box_stats(p.withColumn("e", m.err()), "e", ["model"]),
    "ensemble": st.inverse_error_ensemble,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_results_do_not_depend_on_broadcasts_or_blocks(preds, monkeypatch, name):
    def run():
        df = OPERATORS[name](preds).toPandas()
        keys = [c for c in ("model", "sample_id", "bin", "point", "rn") if c in df.columns]
        return df.sort_values(keys, ignore_index=True)

    want = run()
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(ordering, "BLOCK", 64)
    for fn in (ordering.framed, ordering.running):
        monkeypatch.setattr(fn, "__defaults__", tuple(64 if d == 100_000 else d for d in fn.__defaults__))
    pd.testing.assert_frame_equal(run(), want)


def test_beyond_the_bound_nothing_is_broadcast(spark, cells, monkeypatch):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        small = missing_rate_filter(cells, 0.25)
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(sizing, "BROADCAST_BYTES", 1)
        large = missing_rate_filter(cells, 0.25)
        assert "BroadcastHashJoin" not in large._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, large.select("probe_ord", "sample_id").collect())) == sorted(map(tuple, small.select("probe_ord", "sample_id").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("method", ["mean", "knn"])
def test_imputation_without_broadcasts(cells, monkeypatch, method):
    def run():
        return {(r["probe_ord"], r["sample_id"]): r["beta"] for r in impute(cells, cells, method).collect()}

    want = run()
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", -1)
    assert run() == want


def test_hot_group_is_spread_over_ranges(spark, monkeypatch):
    """Nine tenths of the rows share group and value and still land in several ranges."""
    df = spark.range(200_000).select(
        F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("g"), F.lit(1.0).alias("v"), F.col("id").alias("sample_id")
    )
    kept = []
    store = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda d, label: kept.append(store(d, label)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ordering.numbered(df, ["g"], ["v", "sample_id"], "rn", "n")
        got = rows.where("g = 'hot'").agg(F.max("rn").alias("x"), F.count_distinct("rn").alias("c")).first()
        assert tuple(got) == (180_000, 180_000)
        sizes = [r["count"] for r in kept[0].groupBy(F.shiftright("_slot", 33)).count().collect()]
        assert len(sizes) >= 3 and max(sizes) < 120_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_nested_columns_are_measured_by_what_they_hold(spark, monkeypatch):
    long_lists = spark.range(50).selectExpr("id", "array(repeat('x', 1000), repeat('y', 1000)) as parts", "struct(repeat('z', 500) as a) as s")
    monkeypatch.setattr(sizing, "BROADCAST_BYTES", 100_000)  # 50 rows of 2 500 characters
    assert "broadcast" not in sizing.sized(long_lists)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in sizing.sized(long_lists.select("id"))._jdf.queryExecution().logical().toString().lower()
