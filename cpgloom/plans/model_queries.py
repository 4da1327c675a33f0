"""Model queries.  Selection, imputation and scaling are always fitted on training rows."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cpgloom.functions import scalars as sc
from cpgloom.operators import clocks as ck
from cpgloom.operators import ensembles as en
from cpgloom.operators import foldwise as fw
from cpgloom.operators import linear as ln
from cpgloom.operators import metrics as m
from cpgloom.operators import selection as sel
from cpgloom.operators import strata as st
from cpgloom.operators.design import feature_arrays, with_samples
from cpgloom.operators.impute import impute
from cpgloom.operators.ordering import running
from cpgloom.operators.splits import kfold
from cpgloom.plans import views as v
from cpgloom.plans.matrix_queries import R_SQL, TRAIN_SQL, split_samples
from cpgloom.plans.registry import query, r, rounded
from cpgloom.session import materialize, scratch_path

K = 24
FOLD_SQL = """k5 AS (SELECT sample_id, age, (row_number() OVER (ORDER BY md5(sample_id || '|42'), sample_id) - 1) % 5 AS fold
 FROM annot WHERE age IS NOT NULL)"""


def folded_cells(spark, d, folds: int = 5):
    """Cells of samples with known age and their fold."""
    ids = v.annot(spark, d).where("age is not null").select("sample_id", "age")
    return with_samples(v.beta(spark, d).select("sample_id", "probe_ord", "beta"), kfold(ids, folds))


def split_design(spark, d, k: int = K, method: str = "mean"):
    """One prepared row per sample with its split: (sample_id, label, split, features VECTOR)."""
    parts = materialize(split_samples(spark, d), "parts")
    cells = with_samples(v.beta(spark, d).select("sample_id", "probe_ord", "beta"), parts)
    train = cells.where("split = 'train'")
    chosen = materialize(sel.top_correlated(train, k), "chosen")
    wide = fw.train_design(cells.select("sample_id", "probe_ord", "beta"), train.select("sample_id", "probe_ord", "beta"), chosen, method)
    out = wide.join(parts, "sample_id").select("sample_id", F.col("age").alias("label"), "split", array_to_vector("features").alias("features"))
    return materialize(out, "design")


def fit_and_predict(spark, d, estimator, k: int = K):
    """Fit on train, predict both splits."""
    rows = split_design(spark, d, k)
    model = estimator.fit(rows.where("split = 'train'"))
    return model.transform(rows).select("sample_id", "split", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def array_folds(spark, d, k: int = K, folds: int = 5):
    """Train rows of the split as arrays with an inner fold, for the one-pass searches."""
    rows = split_design(spark, d, k).where("split = 'train'").withColumn("features", vector_to_array("features"))
    return materialize(kfold(rows, folds), "folds")


# --- fold-wise statistics ---------------------------------------------------------------------


@query(
    "v06_selection_by_fold",
    f"""WITH {FOLD_SQL}, f AS (SELECT CAST(held AS BIGINT) AS held FROM range(5) t(held)),
s AS (SELECT f.held AS fold, b.probe_ord, coalesce(count(beta) * covar_pop(beta, age) / nullif(sqrt(count(beta) * var_pop(beta))
  * sqrt(count(age) * var_pop(age)), 0), 0) AS r, avg(beta) AS m FROM beta_long b JOIN k5 ON b.sample_id = k5.sample_id
  JOIN f ON f.held <> k5.fold GROUP BY f.held, b.probe_ord),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY abs(r) DESC, probe_ord) AS rank FROM s WHERE m IS NOT NULL)
SELECT fold, probe_ord, rank, {r('k.r')} AS r FROM k WHERE rank <= 10""",
    "annot beta_long",
)
def _(spark, d):
    top = fw.top_by_fold(fw.fold_statistics(folded_cells(spark, d)), 10)
    return rounded(top.select("fold", "probe_ord", "rank", "r"))


# --- clocks -----------------------------------------------------------------------------------

CLOCK_SQL = """scored AS (SELECT b.sample_id, c.clock, any_value(c.intercept) + coalesce(sum(c.coef * b.beta), 0) AS raw
 FROM beta_long b JOIN probes p ON b.probe_ord = p.probe_ord JOIN clock_coef c ON c.probe_id = p.probe_id GROUP BY b.sample_id, c.clock),
aged_clock AS (SELECT s.sample_id, s.clock, k.age AS y_true, k.fold, CASE WHEN s.clock = 'clock1' THEN
  CASE WHEN raw <= 0 THEN exp(raw + ln(21)) - 1 ELSE 21 * raw + 20 END ELSE raw END AS y_pred FROM scored s JOIN k5 k ON s.sample_id = k.sample_id)"""


def clock_scores(spark, d):
    cells = v.beta(spark, d).join(v.probes(spark, d), "probe_ord").select("sample_id", "probe_id", "beta")
    scored = ck.score_clocks(cells, v.clock_coef(spark, d), transformed=["clock1"])
    ids = kfold(v.annot(spark, d).where("age is not null").select("sample_id", F.col("age").alias("y_true")))
    return scored.join(ids, "sample_id")


@query(
    "m17_clock_scores",
    f"WITH {FOLD_SQL}, {CLOCK_SQL} SELECT sample_id, clock, {r('y_pred')} AS y_pred FROM aged_clock",
    "annot beta_long clock_coef",
)
def _(spark, d):
    return rounded(clock_scores(spark, d).select("sample_id", "clock", "y_pred"))


CALIBRATED_SQL = """lines AS (SELECT o.clock, h.fold, regr_slope(o.y_true, o.y_pred) AS a, regr_intercept(o.y_true, o.y_pred) AS b
 FROM aged_clock o, (SELECT DISTINCT fold FROM k5) h WHERE o.fold <> h.fold GROUP BY o.clock, h.fold),
cal AS (SELECT s.*, a * y_pred + b AS calibrated FROM aged_clock s JOIN lines l ON l.clock = s.clock AND l.fold = s.fold)"""


@query(
    "m18_clock_calibration",
    f"WITH {FOLD_SQL}, {CLOCK_SQL}, {CALIBRATED_SQL} SELECT sample_id, clock, fold, {r('calibrated', 6)} AS calibrated FROM cal",
    "annot beta_long clock_coef",
)
def _(spark, d):
    return rounded(ck.calibrate(clock_scores(spark, d)).select("sample_id", "clock", "fold", "calibrated"), digits=6)


@query(
    "m18_calibration_gain",
    f"""WITH {FOLD_SQL}, {CLOCK_SQL}, {CALIBRATED_SQL} SELECT clock, {r('avg(abs(y_pred - y_true))', 6)} AS mae_raw,
 {r('avg(abs(calibrated - y_true))', 6)} AS mae_calibrated, {r('avg(y_pred - y_true)', 6)} AS bias_raw,
 {r('avg(calibrated - y_true)', 6)} AS bias_calibrated FROM cal GROUP BY clock""",
    "annot beta_long clock_coef",
)
def _(spark, d):
    return rounded(ck.calibration_gain(ck.calibrate(clock_scores(spark, d))), digits=6)


def clock_features(spark, d):
    """Per sample: five clocks, sex and one-hot ethnicity, with age and fold."""
    names = [f"clock{i}" for i in range(1, 6)]
    wide = clock_scores(spark, d).groupBy("sample_id", "y_true", "fold").pivot("clock", names).agg(F.first("y_pred"))
    a = v.annot(spark, d).select("sample_id", sc.parse_bool("female").cast("double").alias("sex"), sc.clean_ethnicity("ethnicity").alias("eth"))
    mean = a.agg(F.avg("sex").alias("m")).select("m").scalar()
    a = sc.one_hot(a.withColumn("sex", F.coalesce("sex", mean)), "eth", ["Asian", "Black", "Hispanic", "Inconnu", "White"], "eth", drop_first=True)
    eth = [c for c in a.columns if c.startswith("eth_")]
    rows = wide.join(a, "sample_id")
    feats = F.array(*[F.col(c) for c in [*names, "sex", *eth]])
    return materialize(rows.select("sample_id", F.col("y_true").alias("label"), "fold", feats.alias("features")), "clocks")


@query("m19_clock_stacking_grid")
def _(spark, d):
    sums = ln.FoldSums(clock_features(spark, d))
    clocks, sex, eth = list(range(5)), [5], list(range(6, sums.width))
    configs = {"clocks": clocks, "clocks + sex": clocks + sex, "clocks + sex + ethnicity": clocks + sex + eth, "three clocks + sex + ethnicity": [0, 1, 2] + sex + eth}
    learners = {"ridge 1": (1.0, None), "ridge 10": (10.0, None), "ridge 100": (100.0, None), "elastic net 0.01": (0.01, 0.5)}
    fits = {f"{c} | {n}": sums.per_fold(a, rho, cols) for c, cols in configs.items() for n, (a, rho) in learners.items()}
    return sums.held_out_scores(fits).orderBy("mae", "name")


@query(
    "m22_missing_probe_robustness",
    f"""WITH {FOLD_SQL}, coefs AS (SELECT b.probe_ord, any_value(c.coef) AS coef, avg(b.beta) AS center FROM beta_long b
  JOIN probes p ON p.probe_ord = b.probe_ord JOIN clock_coef c ON c.probe_id = p.probe_id AND c.clock = 'clock2'
  JOIN k5 ON k5.sample_id = b.sample_id WHERE k5.fold <> 0 GROUP BY b.probe_ord),
cells AS (SELECT b.sample_id, b.probe_ord, k5.age AS y_true, coef, center, coalesce(b.beta, center) AS x, i AS iteration,
  CAST(('0x' || substr(md5(b.sample_id || '|' || b.probe_ord || '|' || i), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM beta_long b JOIN coefs c ON c.probe_ord = b.probe_ord JOIN k5 ON k5.sample_id = b.sample_id, range(30) t(i) WHERE k5.fold = 0),
p AS (SELECT sample_id, iteration, g AS rate, any_value(y_true) AS y_true, sum(coef * CASE WHEN u < g THEN center ELSE x END) + 50.0::DOUBLE AS y_pred
  FROM cells, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95]::DOUBLE[]) AS g) GROUP BY sample_id, iteration, g),
e AS (SELECT rate, iteration, avg(abs(y_pred - y_true)) AS mae FROM p GROUP BY rate, iteration)
SELECT rate AS missing_rate, {r('avg(mae)', 6)} AS mae_mean, {r('stddev_pop(mae)', 6)} AS mae_std, {r('quantile_cont(mae, 0.5)', 6)} AS mae_median FROM e GROUP BY rate""",
    "annot beta_long clock_coef",
)
def _(spark, d):
    cells = materialize(folded_cells(spark, d).withColumnRenamed("age", "y_true"), "cells")
    one = v.clock_coef(spark, d).where("clock = 'clock2'").join(v.probes(spark, d), "probe_id").select("probe_ord", "coef")
    centers = cells.where("fold <> 0").groupBy("probe_ord").agg(F.avg("beta").alias("center"))
    out = ck.robustness(cells.where("fold = 0"), one.join(centers, "probe_ord"), 50.0, [0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95], 30)
    return rounded(out, digits=6)


# --- single models ----------------------------------------------------------------------------


@query(
    "m01_penalties_closed_form",
    f"""WITH x AS (SELECT b.sample_id, any_value(a.age) AS y, avg(beta) * 100 AS x FROM beta_long b JOIN annot a ON a.sample_id = b.sample_id
  WHERE a.age IS NOT NULL GROUP BY b.sample_id),
s AS (SELECT count(*) AS n, covar_pop(x, y) AS c, var_pop(x) AS v, avg(x) AS mx, avg(y) AS my FROM x),
w AS (SELECT 'ols' AS model, c / v AS coef, mx, my FROM s UNION ALL SELECT 'ridge', c / (v + 200.0::DOUBLE / n), mx, my FROM s
 UNION ALL SELECT 'lasso', sign(c) * greatest(abs(c) - 0.5::DOUBLE, 0) / v, mx, my FROM s
 UNION ALL SELECT 'elastic net', sign(c) * greatest(abs(c) - 0.2::DOUBLE, 0) / (v + 0.2::DOUBLE), mx, my FROM s)
SELECT model, {r('coef', 4)} AS coef, {r('my - coef * mx', 2)} AS intercept FROM w""",
    "beta_long annot",
)
def _(spark, d):
    ages = v.annot(spark, d).where("age is not null").select("sample_id", F.col("age").alias("label"))
    means = v.beta(spark, d).groupBy("sample_id").agg((F.avg("beta") * 100).alias("x")).join(ages, "sample_id")
    rows = materialize(means.select("label", array_to_vector(F.array("x")).alias("features")), "one-feature")
    fits = {"ols": ln.ridge(0.0), "ridge": ln.ridge(200.0), "lasso": ln.lasso(0.5), "elastic net": ln.elastic_net(0.4, 0.5)}
    out = []
    for name, est in fits.items():
        model = est.fit(rows)
        out.append((name, float(model.coefficients[0]), float(model.intercept)))
    # One row per fitted model.
    table = spark.createDataFrame(out, "model STRING, coef DOUBLE, intercept DOUBLE")
    return rounded(rounded(table, "coef", digits=4), "intercept", digits=2)


@query("m01_ridge")
def _(spark, d):
    return fit_and_predict(spark, d, ln.ridge(1.0))


@query("m01_lasso")
def _(spark, d):
    return fit_and_predict(spark, d, ln.lasso(0.1))


@query("m01_elastic_net")
def _(spark, d):
    return fit_and_predict(spark, d, ln.elastic_net(0.1, 0.5))


@query("m02_tuned_elastic_net")
def _(spark, d):
    return fit_and_predict(spark, d, en.TunedElasticNet())


@query("m02_cross_validated_linear")
def _(spark, d):
    rows = split_design(spark, d, 12)
    train = kfold(rows.where("split = 'train'"), 3)
    cv = ln.cross_validated([0.01, 0.1], [0.0, 0.5], folds=3).fit(train.withColumn("fold", F.col("fold").cast("int")))
    return cv.transform(rows).select("sample_id", "split", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


@query("m03_random_forest")
def _(spark, d):
    return fit_and_predict(spark, d, en.forest(100, 10))


@query("m04_gradient_boosting")
def _(spark, d):
    return fit_and_predict(spark, d, en.boosting(100, 3))


KNN_SQL = f"""WITH {TRAIN_SQL}, s AS (SELECT probe_ord, {R_SQL} AS r, avg(beta) AS mu FROM train GROUP BY probe_ord),
top AS (SELECT probe_ord, mu FROM s ORDER BY abs(s.r) DESC, probe_ord LIMIT {K}),
sd AS (SELECT t.probe_ord, stddev_pop(t.beta) AS sd FROM train t GROUP BY t.probe_ord),
z AS (SELECT p.sample_id, p.split, p.age, b.probe_ord, (coalesce(b.beta, top.mu) - top.mu) / CASE WHEN sd.sd = 0 THEN 1 ELSE sd.sd END AS z
  FROM beta_long b JOIN parts p ON p.sample_id = b.sample_id JOIN top ON top.probe_ord = b.probe_ord JOIN sd ON sd.probe_ord = b.probe_ord),
d AS (SELECT a.sample_id, t.sample_id AS did, any_value(a.split) AS split, any_value(a.age) AS y_true, any_value(t.age) AS y,
  round(sqrt(sum((a.z - t.z) * (a.z - t.z))), 10) AS dist FROM z a JOIN z t ON a.probe_ord = t.probe_ord
  WHERE t.split = 'train' AND a.sample_id <> t.sample_id GROUP BY a.sample_id, t.sample_id),
k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY dist, did) AS rk FROM d)
SELECT sample_id, any_value(split) AS split, {r('any_value(y_true)', 6)} AS y_true, {r('sum(y / dist) / sum(1 / dist)', 6)} AS y_pred FROM k WHERE rk <= 8 GROUP BY sample_id"""


@query("m05_neighbour_regression", KNN_SQL, "annot beta_long")
def _(spark, d):
    return rounded(fit_and_predict(spark, d, en.NeighbourRegressor(8)), digits=6)


@query("m06_residual_learning")
def _(spark, d):
    return fit_and_predict(spark, d, en.ResidualLearner())


@query("m07_residual_fit_report")
def _(spark, d):
    rows = split_design(spark, d)
    info = en.ResidualLearner().fit(rows.where("split = 'train'")).info()
    # One fitted model, one row.
    return spark.createDataFrame([tuple(info.values())], "alpha DOUBLE, l1_ratio DOUBLE, n_nonzero INT, n_trees INT, w_linear DOUBLE, w_residual DOUBLE, bias DOUBLE")


@query("m08_stacking")
def _(spark, d):
    return fit_and_predict(spark, d, en.stacking_presets()["mixed"])


@query("m08_linear_stack")
def _(spark, d):
    return fit_and_predict(spark, d, en.stacking_presets()["linear"])


@query("m09_band_correction")
def _(spark, d):
    return fit_and_predict(spark, d, en.BandCorrection(ln.elastic_net(0.1, 0.5)))


@query("m10_segmented_models")
def _(spark, d):
    return fit_and_predict(spark, d, en.SegmentedModel(rounds=50))


@query("m11_recursive_elimination")
def _(spark, d):
    scores, _sizes = ln.eliminate(ln.FoldSums(array_folds(spark, d, 48, 3)), step=8, smallest=8)
    return scores.select("n_features", "n", "mae", "r2").orderBy("mae")


@query("m12_feature_count_sweep")
def _(spark, d):
    return ln.k_sweep(ln.FoldSums(array_folds(spark, d, 48)), [8, 16, 32, 48]).orderBy("mae", "k")


@query("m13_transformed_target")
def _(spark, d):
    return fit_and_predict(spark, d, en.TransformedTarget(ln.elastic_net(0.001, 0.5), sc.age_to_clock, sc.clock_to_age))


@query("m14_polynomial_elastic_net")
def _(spark, d):
    rows = split_design(spark, d, 50)
    wide = materialize(rows.withColumn("features", array_to_vector(sc.polynomial2(vector_to_array("features")))), "products")
    model = en.TunedElasticNet([0.5], 100, 5).fit(wide.where("split = 'train'"))
    return model.transform(wide).select("sample_id", "split", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


@query("m15_spline_ridge")
def _(spark, d):
    return fit_and_predict(spark, d, en.SplineRidge(), k=20)


@query("m16_fourier_ridge")
def _(spark, d):
    return fit_and_predict(spark, d, en.FourierRidge())


@query("m20_principal_components")
def _(spark, d):
    rows = split_design(spark, d)
    pca = PCA(k=10, inputCol="features", outputCol="pc").fit(rows.where("split = 'train'"))
    return pca.transform(rows).select("sample_id", vector_to_array("pc").alias("pc"))


@query("w07_cumulative_variance")
def _(spark, d):
    rows = split_design(spark, d).where("split = 'train'")
    pca = PCA(k=10, inputCol="features", outputCol="pc").fit(rows)
    shares = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(pca.explainedVariance)], "component BIGINT, share DOUBLE")
    return running(shares, [], "component", "share", "cumulative")


@query("m21_random_search")
def _(spark, d):
    return ln.random_search(ln.FoldSums(array_folds(spark, d)), 20)


@query("m23_feature_blocks")
def _(spark, d):
    parts = materialize(split_samples(spark, d), "parts")
    cells = with_samples(v.beta(spark, d).select("sample_id", "probe_ord", "beta"), parts)
    train = cells.where("split = 'train'")
    chosen = materialize(sel.top_correlated(train, 16), "chosen")
    b, t = cells.select("sample_id", "probe_ord", "beta"), train.select("sample_id", "probe_ord", "beta")
    beta = fw.train_design(b, t, chosen)
    mval = fw.train_design(*[x.withColumn("beta", sc.m_value("beta")) for x in (b, t)], chosen)
    a = v.annot(spark, d).select("sample_id", sc.parse_bool("female").cast("double").alias("sex"), sc.clean_ethnicity("ethnicity").alias("eth"))
    mean = a.join(parts.where("split = 'train'"), "sample_id").agg(F.avg("sex").alias("m")).select("m").scalar()
    a = sc.one_hot(a.withColumn("sex", F.coalesce("sex", mean)), "eth", ["Asian", "Black", "Hispanic", "Inconnu", "White"], "eth")
    demo = a.select("sample_id", F.array("sex", *[c for c in a.columns if c.startswith("eth_")]).alias("features"))
    from cpgloom.operators.relational import feature_blocks

    rows = feature_blocks([beta, demo, mval]).join(parts.where("split = 'train'"), "sample_id")
    rows = materialize(kfold(rows.select("sample_id", F.col("age").alias("label"), "features")), "blocks")
    sums = ln.FoldSums(rows)
    be, sex, de, mv = list(range(16)), [16], list(range(16, 22)), list(range(22, 38))
    configs = {"beta": be, "beta + sex": be + sex, "beta + demographics": be + de, "m + demographics": mv + de}
    return sums.held_out_scores({n: sums.per_fold(0.1, 0.5, c) for n, c in configs.items()}).orderBy("mae")


# --- evaluation loops -------------------------------------------------------------------------


@query(
    "v08_leak_guard",
    f"""WITH {FOLD_SQL} SELECT k5.fold AS fold, count(DISTINCT probe_ord) AS n_probes, 0::BIGINT AS n_changed FROM beta_long b
JOIN k5 ON k5.sample_id = b.sample_id GROUP BY k5.fold""",
    "annot beta_long",
)
def _(spark, d):
    cells = materialize(folded_cells(spark, d), "cells")
    base = materialize(fw.fold_statistics(cells), "fold-statistics")
    out = None
    for f in range(5):
        own = F.col("fold") == f
        bent = cells.withColumns({"beta": F.when(own, 1 - F.col("beta")).otherwise(F.col("beta")), "age": F.when(own, F.col("age") + 7).otherwise(F.col("age"))})
        a = base.where(own)
        b = fw.fold_statistics(bent).where(own).withColumnsRenamed({"r": "r2", "center": "c2", "spread": "s2"})
        moved = F.lit(False)
        for x, y in (("r", "r2"), ("center", "c2"), ("spread", "s2")):
            gap = F.coalesce(F.abs(F.col(x) - F.col(y)), F.when(F.col(x).isNull() & F.col(y).isNull(), 0.0).otherwise(1.0))
            moved = moved | (gap > 1e-9)
        part = a.join(b, ["fold", "probe_ord"]).groupBy("fold").agg(F.count("*").alias("n_probes"), F.count_if(moved).alias("n_changed"))
        out = part if out is None else out.unionByName(part)
    return out


@query("v06_out_of_fold_predictions")
def _(spark, d):
    cells = materialize(folded_cells(spark, d), "cells")
    designs = materialize(fw.fold_designs(cells, K), "designs").withColumn("features", array_to_vector("features"))
    out = None
    for f in range(5):
        mine = designs.where(F.col("fold") == f)
        train, test = mine.where(F.col("own_fold") != f), mine.where(F.col("own_fold") == f)
        for name, est in {"ElasticNetCV": en.TunedElasticNet(n_alphas=30), "Ridge": ln.ridge(1.0)}.items():
            part = est.fit(train).transform(test).select(
                F.lit(name).alias("model"), "sample_id", F.col("own_fold").alias("fold"), F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")
            )
            out = part if out is None else out.unionByName(part)
    return out


@query("v05_nested_cross_validation")
def _(spark, d):
    cells = materialize(folded_cells(spark, d), "cells")
    designs = materialize(fw.fold_designs(cells, K), "designs")
    out = None
    for f in range(5):
        mine = designs.where(F.col("fold") == f)
        train = kfold(mine.where(F.col("own_fold") != f).select("sample_id", "label", "features"), 3)
        fit = ln.FoldSums(materialize(train, "inner")).tune([0.1, 0.5, 0.9], 20)
        e = fit.column("features") - F.col("label")
        part = mine.where(F.col("own_fold") == f).agg(
            F.lit(f).cast("long").alias("fold"), F.lit(fit.alpha).alias("alpha"), F.lit(fit.rho).alias("l1_ratio"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("i08_imputation_comparison")
def _(spark, d):
    cells = materialize(folded_cells(spark, d), "cells")
    scores = None
    for f in range(5):
        train = cells.where(F.col("fold") != f)
        chosen = materialize(sel.top_correlated(train, K), "chosen")
        pick = F.broadcast(chosen.select("probe_ord", "rank"))  # K rows
        sub, base = cells.join(pick, "probe_ord", "left_semi"), train.join(pick, "probe_ord", "left_semi")
        ages = cells.select("sample_id", "fold", "age").distinct()
        for method in ["zero", "mean", "median", "knn", "mice"]:
            filled = impute(sub.select("sample_id", "probe_ord", "beta"), base.select("sample_id", "probe_ord", "beta"), method)
            rows = materialize(feature_arrays(filled.join(pick, "probe_ord")).join(ages, "sample_id").withColumnRenamed("age", "label"), "imputed")
            inner = rows.where(F.col("fold") != f).withColumn("fold", F.pmod(F.xxhash64("sample_id"), F.lit(3)))
            fit = ln.FoldSums(inner).tune([0.1, 0.5, 0.9], 30)
            e = F.abs(fit.column("features") - F.col("label"))
            part = rows.where(F.col("fold") == f).agg(F.lit(method).alias("model"), F.lit(f).cast("long").alias("fold"), F.avg(e).alias("mae"))
            scores = part if scores is None else scores.unionByName(part)
    return m.cv_summary(scores, ["mae"])


def training_models():
    """The models of a training run, at their published settings."""
    return {
        "ElasticNet": ln.elastic_net(0.1, 0.5),
        "Lasso": ln.lasso(0.1),
        "Ridge": ln.ridge(100.0),
        "RandomForest": en.forest(100, 10, 1),
    }


@query("m24_training_run")
def _(spark, d):
    rows = split_design(spark, d)
    train = rows.where("split = 'train'")
    preds = None
    for name, est in training_models().items():
        model = est.fit(train)
        model.write().overwrite().save(scratch_path(spark, f"model-{name}"))
        part = model.transform(rows).select(
            F.lit(name).alias("model"), "sample_id", "split", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")
        )
        preds = part if preds is None else preds.unionByName(part)
    return m.metrics_table(materialize(preds, "predictions"), n_features=K)


@query("a16_saved_model_predictions")
def _(spark, d):
    from pyspark.ml.regression import LinearRegressionModel

    rows = split_design(spark, d)
    path = scratch_path(spark, "model")
    ln.ridge(1.0).fit(rows.where("split = 'train'")).write().overwrite().save(path)
    return LinearRegressionModel.load(path).transform(rows).select("sample_id", "prediction")
