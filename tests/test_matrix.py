import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgloom.operators import foldwise as fw
from cpgloom.operators import impute as im
from cpgloom.operators import probe_stats as ps
from cpgloom.operators import selection as sel
from cpgloom.operators import splits
from cpgloom.operators.design import feature_arrays
from cpgloom.operators.scaling import standard_apply, standard_fit


def as_map(df, value="beta"):
    return {(r["probe_ord"], r["sample_id"]): r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def noisy(spark):
    """60 samples, 8 correlated probes, 10 % gaps, and the age behind them."""
    rng = np.random.default_rng(1)
    age = rng.uniform(20, 80, 60)
    x = 0.2 + np.outer(age, np.linspace(0.1, 0.8, 8)) / 120 + rng.normal(0, 0.02, (60, 8))
    gaps = rng.random(x.shape) < 0.1
    rows = [(j, f"s{i:02d}", None if gaps[i, j] else float(x[i, j]), float(age[i])) for i in range(60) for j in range(8)]
    df = spark.createDataFrame(rows, "probe_ord BIGINT, sample_id STRING, beta DOUBLE, age DOUBLE")
    return df, np.where(gaps, np.nan, x), x, age


# --- missing-rate filter ------------------------------------------------------------------------


@pytest.mark.parametrize("limit, kept", [(0.5, {0, 1, 2}), (0.25, {0, 2}), (0.2, {2}), (0.0, {0, 1, 2}), (-0.1, {0, 1, 2})])
def test_missing_rate_limits(cells, limit, kept):
    got = ps.missing_rate_filter(cells, limit)
    assert {r["probe_ord"] for r in got.select("probe_ord").distinct().collect()} == kept


# --- correlation --------------------------------------------------------------------------------


def filled_r(x, y):
    x = np.where(np.isnan(x), np.nanmean(x) if not np.isnan(x).all() else 0.0, x)
    a, b = x - x.mean(), y - y.mean()
    den = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
    return 0.0 if den < 1e-15 else float(a @ b / den)


def test_correlation_fills_gaps_with_the_mean(noisy):
    df, x, _, age = noisy
    got = {r["probe_ord"]: r["r"] for r in ps.probe_correlation(df).collect()}
    for j in range(8):
        assert got[j] == pytest.approx(filled_r(x[:, j], age))
        assert -1.0 <= got[j] <= 1.0


def test_grouped_correlation_fills_with_the_overall_mean(noisy):
    df, x, _, age = noisy
    grouped = df.withColumn("g", F.substring("sample_id", 3, 1).cast("int") % 2)
    got = {(r["probe_ord"], r["g"]): r["r"] for r in ps.probe_correlation(grouped, ["g"]).collect()}
    g = np.arange(60) % 10 % 2
    for j in range(8):
        full = np.where(np.isnan(x[:, j]), np.nanmean(x[:, j]), x[:, j])
        for k in (0, 1):
            assert got[(j, k)] == pytest.approx(np.corrcoef(full[g == k], age[g == k])[0, 1])


def test_constant_and_empty_probes_have_zero_correlation(spark):
    rows = [(0, "a", 0.5, 1.0), (0, "b", 0.5, 2.0), (1, "a", None, 1.0), (1, "b", None, 2.0)]
    df = spark.createDataFrame(rows, "probe_ord BIGINT, sample_id STRING, beta DOUBLE, age DOUBLE")
    assert {r["r"] for r in ps.probe_correlation(df).collect()} == {0.0}


def test_two_stage_selection_orders_by_ordinal(noisy):
    df, x, _, age = noisy
    got = [r["probe_ord"] for r in sel.two_stage(df, 5, 3).collect()]
    var = np.nanvar(x, axis=0)
    wide = np.argsort(-var)[:5]
    want = sorted(sorted(wide, key=lambda j: -abs(filled_r(x[:, j], age)))[:3])
    assert got == want


# --- splits -------------------------------------------------------------------------------------


def test_folds_partition_and_splits_have_exact_size(spark):
    ids = spark.range(103).select(F.col("id").cast("string").alias("sample_id"))
    folds = splits.kfold(ids, 5)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21] and folds.select("sample_id").distinct().count() == 103
    assert splits.train_test_split(ids).where("split = 'test'").count() == 21
    again = {tuple(r) for r in splits.kfold(ids.repartition(3), 5).collect()}
    assert again == {tuple(r) for r in folds.collect()}
    rep = splits.repeated_kfold(ids, 5, 2)
    assert rep.groupBy("repeat").count().where("count <> 103").count() == 0
    assert splits.validation_split(ids).where("is_validation").count() == 20
    assert splits.validation_split(ids.limit(30)).where("is_validation").count() == 20


# --- fold-wise preparation ----------------------------------------------------------------------


def test_fold_statistics_equal_separate_fits(noisy):
    df, *_ = noisy
    folded = df.withColumn("fold", F.substring("sample_id", 3, 1).cast("int") % 3)
    got = {(r["fold"], r["probe_ord"]): r for r in fw.fold_statistics(folded).collect()}
    for f in range(3):
        train = folded.where(F.col("fold") != f)
        r = {x["probe_ord"]: x["r"] for x in ps.probe_correlation(train).collect()}
        s = {x["probe_ord"]: x for x in standard_fit(train).collect()}
        for p in range(8):
            assert got[(f, p)]["r"] == pytest.approx(r[p])
            assert got[(f, p)]["center"] == pytest.approx(s[p]["center"])
            assert got[(f, p)]["spread"] == pytest.approx(s[p]["spread"])


def test_held_out_values_do_not_leak(noisy):
    """Changing the held-out samples leaves every statistic of that fold as it was."""
    df, *_ = noisy
    folded = df.withColumn("fold", F.substring("sample_id", 3, 1).cast("int") % 3)
    bent = folded.withColumn("beta", F.when(F.col("fold") == 1, 1 - F.col("beta")).otherwise(F.col("beta")))
    a = {r["probe_ord"]: r for r in fw.fold_statistics(folded).where("fold = 1").collect()}
    b = {r["probe_ord"]: r for r in fw.fold_statistics(bent).where("fold = 1").collect()}
    for p in a:
        assert a[p]["r"] == pytest.approx(b[p]["r"]) and a[p]["center"] == pytest.approx(b[p]["center"])
    da = {r["sample_id"]: r["features"] for r in fw.fold_designs(folded, 4).where("fold = 1 and own_fold <> 1").collect()}
    db = {r["sample_id"]: r["features"] for r in fw.fold_designs(bent, 4).where("fold = 1 and own_fold <> 1").collect()}
    assert all(np.allclose(da[s], db[s]) for s in da)


@pytest.mark.parametrize("method", ["mean", "median", "knn"])
def test_imputation_statistics_come_from_train_only(noisy, method):
    df, *_ = noisy
    slim = df.select("probe_ord", "sample_id", "beta")
    train, test = slim.where("sample_id < 's40'"), slim.where("sample_id >= 's40'")
    bent = test.withColumn("beta", F.col("beta") * 0.1)
    a = as_map(im.impute(train.unionByName(test), train, method))
    b = as_map(im.impute(train.unionByName(bent), train, method))
    assert all(a[k] == pytest.approx(b[k]) for k in a if k[1] < "s40")


# --- imputation ---------------------------------------------------------------------------------


@pytest.mark.parametrize("method", im.METHODS)
def test_no_gap_left_and_observed_cells_identical(noisy, method):
    df, x, *_ = noisy
    slim = df.select("probe_ord", "sample_id", "beta")
    out = im.impute(slim, slim, method)
    got, before = as_map(out), as_map(slim)
    assert set(got) == set(before) and all(v is not None for v in got.values())
    assert all(got[k] == v for k, v in before.items() if v is not None)
    marked = {(r["probe_ord"], r["sample_id"]) for r in out.where("imputed").collect()}
    assert marked == {k for k, v in before.items() if v is None}


def test_median_of_outlier_row(spark):
    rows = [(0, f"s{i}", v) for i, v in enumerate([1.0, 2.0, 4.0, 100.0, None])]
    df = spark.createDataFrame(rows, "probe_ord BIGINT, sample_id STRING, beta DOUBLE")
    assert as_map(im.impute(df, df, "median"))[(0, "s4")] == 3.0
    assert as_map(im.impute(df, df, "mean"))[(0, "s4")] == pytest.approx(26.75)
    assert as_map(im.impute(df, df, "zero"))[(0, "s4")] == 0.0


def test_unknown_method_is_an_error(cells):
    with pytest.raises(ValueError):
        im.impute(cells, cells, "magic")


def test_probe_without_values_is_dropped_or_kept(spark):
    rows = [(0, "a", 0.5), (0, "b", None), (1, "a", None), (1, "b", None)]
    df = spark.createDataFrame(rows, "probe_ord BIGINT, sample_id STRING, beta DOUBLE")
    assert {k[0] for k in as_map(im.impute(df, df, "mean"))} == {0}
    kept = as_map(im.impute(df, df, "mean", empty=0.5))
    assert kept[(1, "a")] == 0.5 and kept[(0, "b")] == 0.5
    assert as_map(im.impute(df, df, "knn"))[(0, "b")] == 0.5


def test_neighbour_values_are_means_of_nearest_donors(spark):
    rows = [("s0", [0.1, None]), ("s1", [0.1, 0.2]), ("s2", [0.12, 0.4]), ("s3", [0.9, 0.9])]
    cells = [(j, s, v) for s, vec in rows for j, v in enumerate(vec)]
    df = spark.createDataFrame(cells, "probe_ord BIGINT, sample_id STRING, beta DOUBLE")
    assert as_map(im.knn_fill(df, df, k=2, block=2))[(1, "s0")] == pytest.approx(0.3)


def test_chained_equations_beat_the_mean(noisy):
    df, x, full, _ = noisy
    slim = df.select("probe_ord", "sample_id", "beta")
    gaps = np.argwhere(np.isnan(x))

    def rmse(method):
        got = as_map(im.impute(slim, slim, method))
        return np.sqrt(np.mean([(got[(j, f"s{i:02d}")] - full[i, j]) ** 2 for i, j in gaps]))

    assert rmse("mice") < 0.5 * rmse("mean")


def test_scaler_uses_population_sd(noisy):
    df, x, *_ = noisy
    z = as_map(standard_apply(df, standard_fit(df)), "z")
    j = 3
    want = (x[:, j] - np.nanmean(x[:, j])) / np.nanstd(x[:, j])
    for i in range(60):
        assert z[(j, f"s{i:02d}")] is None if np.isnan(want[i]) else z[(j, f"s{i:02d}")] == pytest.approx(want[i])


def test_arrays_follow_rank(spark, cells):
    ranks = spark.createDataFrame([(2, 1), (0, 2)], "probe_ord BIGINT, rank BIGINT")
    got = {r["sample_id"]: r["features"] for r in feature_arrays(sel.keep_probes(cells, ranks, ("rank",))).collect()}
    assert got["s0"] == [0.2, 0.1] and got["s1"] == [0.2, None]


@pytest.mark.parametrize("gaps, offset", [(0.0, 0.0), (0.3, 0.0), (0.3, 1e6)])
def test_nearest_rows_equal_brute_force_over_small_tiles(monkeypatch, gaps, offset):
    monkeypatch.setattr(im, "TILE", (7, 11))
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 5)).round(1) + offset, rng.normal(size=(50, 5)).round(1) + offset
    b[:20] = b[0]  # one large group of copies
    a[rng.random(a.shape) < gaps], b[rng.random(b.shape) < gaps] = np.nan, np.nan

    def brute(x, donors):
        gap = x - b[donors]
        shared = (~np.isnan(gap)).sum(1)
        far = np.round(np.sqrt(np.nansum(gap * gap, 1) * 5 / np.maximum(shared, 1)), 10)
        return [int(donors[j]) for j in np.lexsort((donors, far)) if shared[j]][:4]

    i, j, _ = im._nearest(a, b, 4)
    assert [(int(x), int(y)) for x, y in zip(i, j, strict=True)] == [(x, y) for x in range(30) for y in brute(a[x], np.arange(50))]
    i, c, j, _ = im._donors_of_gaps(a, b, 4)
    want = {(x, y, z) for x, y in np.argwhere(np.isnan(a)) for z in brute(a[x], np.flatnonzero(~np.isnan(b[:, y])))}
    assert {(x, y, z) for x, y, z in zip(i, c, j, strict=True)} == want


def test_copies_of_neighbour_rows_do_not_grow_with_the_table(spark):
    """40 times the rows are copied to as many blocks as before, a few."""
    few, many = (spark.range(n).select(F.col("id").cast("string").alias("sample_id"), F.array(F.col("id").cast("double")).alias("features")) for n in (500, 20_000))
    copies = [im._block_pairs(df, df, None)[0].count() / df.count() for df in (few, many)]
    assert copies[1] <= copies[0]


def test_known_edges_spare_the_distances_of_later_tiles(monkeypatch):
    """Only the first columns of a tile are measured in full; rows without values, own rows and ties come out as by brute force."""
    monkeypatch.setattr(im, "TILE", (16, 40))
    measured, about = [], im._about
    monkeypatch.setattr(im, "_about", lambda a, b: measured.append((len(a.norm), len(b.norm))) or about(a, b))
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 6)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[[3, 77, 301]] = np.nan
    i, j, d = im._nearest(x[:64], x, 3, [np.array([at]) for at in range(64)])
    want = []
    for at in range(64):
        gap = x[at] - x
        shared = (~np.isnan(gap)).sum(1)
        far = np.round(np.sqrt(np.nansum(gap * gap, 1) * 6 / np.maximum(shared, 1)), 10)
        want += [(at, int(y), far[y]) for y in np.lexsort((np.arange(400), far)) if shared[y] and y != at][:3]
    assert [(int(p), int(q)) for p, q in zip(i, j, strict=True)] == [w[:2] for w in want]
    assert np.allclose(d, [w[2] for w in want])
    assert sum(n * m for n, m in measured) < 0.2 * 64 * 400
