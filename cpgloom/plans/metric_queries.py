"""Queries over predictions: metrics, tests, ordered statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cpgloom.functions.scalars import threshold_label
from cpgloom.operators import metrics as m
from cpgloom.plans import views as v
from cpgloom.plans.registry import query, r, rd, rounded

E, AE = "(y_pred - y_true)", "abs(y_pred - y_true)"
SLOPE = "covar_pop(y_pred, y_true) / var_pop(y_true)"
R2 = f"1 - sum({E} * {E}) / (var_pop(y_true) * count(*))"
CORR = "covar_pop(y_true, y_pred) / (sqrt(var_pop(y_true)) * sqrt(var_pop(y_pred)))"


@query(
    "d09_error_metrics",
    f"""SELECT model, count(*) AS n, {r(f'avg({AE})')} AS mae, {r(f'sqrt(avg({E} * {E}))')} AS rmse, {r(R2)} AS r2,
 {r(CORR)} AS correlation, {r(f'avg({E})')} AS bias, {r(f'quantile_cont({AE}, 0.5)')} AS mad FROM pred_long GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.error_metrics(v.preds(spark, d)))


@query(
    "d09_error_metrics_published_precision",
    f"""SELECT model, round(avg({AE}), 3) AS mae, round(sqrt(avg({E} * {E})), 3) AS rmse, round({R2}, 4) AS r2,
 round({CORR}, 4) AS correlation, round(quantile_cont({AE}, 0.5), 3) AS mad FROM pred_long GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return m.metrics_rounded(m.error_metrics(v.preds(spark, d))).select("model", "mae", "rmse", "r2", "correlation", "mad")


@query(
    "w03_ranked_metrics_table",
    f"""WITH x AS (SELECT model, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
 avg({AE}) AS mae, quantile_cont({AE}, 0.5) AS mad, sqrt(avg({E} * {E})) AS rmse, {R2} AS r2, {CORR} AS correlation,
 avg({AE}) FILTER (split = 'train') AS mae_train, avg({AE}) FILTER (split = 'test') AS mae_test FROM pred_long GROUP BY model)
SELECT row_number() OVER (ORDER BY mae, model) AS rank, model, CAST(NULL AS DOUBLE) AS fit_time_sec, 500::BIGINT AS n_features,
 n_train, n_test, {r('mae')} AS mae, {r('mad')} AS mad, {r('rmse')} AS rmse, {r('x.r2')} AS r2, {r('correlation')} AS correlation,
 {r('mae_train')} AS mae_train, {r('mae_test / mae_train')} AS overfitting_ratio FROM x""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.metrics_table(v.preds(spark, d), n_features=500))


@query(
    "d10_overfitting_ratio",
    f"""SELECT model, {r(f"avg({AE}) FILTER (split = 'train')")} AS mae_train, {r(f"avg({AE}) FILTER (split = 'test')")} AS mae_test,
 {r(f"avg({AE}) FILTER (split = 'test') / avg({AE}) FILTER (split = 'train')")} AS overfitting_ratio FROM pred_long GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.overfitting(v.preds(spark, d)))


SKEW = "avg((e - mu) ** 3) / var_pop(e) ** 1.5"
MU = "src AS (SELECT *, y_pred - y_true AS e, avg(y_pred - y_true) OVER (PARTITION BY model) AS mu FROM pred_long)"


@query(
    "d11_extended_statistics",
    f"""WITH {MU} SELECT model, count(*) AS n, {r('sqrt(avg(e * e)) / avg(y_true) * 100')} AS cv_pct,
 {r('2 * covar_pop(y_true, y_pred) / (var_pop(y_true) + var_pop(y_pred) + (avg(y_true) - avg(y_pred)) ** 2)')} AS ccc,
 {r('stddev_pop(e)')} AS residual_sd, {r(SKEW)} AS skew, {r('avg((e - mu) ** 4) / var_pop(e) ** 2 - 3')} AS excess_kurtosis,
 {r('regr_slope(e, y_true)')} AS residual_slope, {r('regr_intercept(e, y_true)')} AS residual_intercept,
 {r('min(y_true)')} AS age_min, {r('max(y_true)')} AS age_max,
 {r('quantile_cont(abs(e), 0.75) - quantile_cont(abs(e), 0.25)')} AS iqr FROM src GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.extended_stats(v.preds(spark, d)))


@query(
    "d12_mape_and_icc",
    f"""SELECT model, {r(f'avg({AE} / greatest(y_true, 1)) * 100')} AS mape,
 {r(f'var_pop(y_true) / (var_pop(y_true) + var_pop({E}))')} AS icc FROM pred_long GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.mape_icc(v.preds(spark, d)))


CURVE = f"""edges AS (SELECT model, quantile_cont(y_true, [{', '.join(f'{i / 10}' for i in range(1, 10))}]) AS ed
 FROM pred_long GROUP BY model),
binned AS (SELECT p.*, len(list_filter(ed, lambda x: x <= y_true)) AS bin FROM pred_long p JOIN edges e ON p.model = e.model),
curve AS (SELECT model, bin, avg(y_true) AS mean_true, avg(y_pred) AS mean_pred,
 coalesce(stddev_samp({E}), 0) AS sd_error, count(*) AS n FROM binned GROUP BY model, bin)"""


@query(
    "d21_calibration_curve",
    f"""WITH {CURVE} SELECT model, bin, {r('mean_true', 7)} AS mean_true, {r('mean_pred', 7)} AS mean_pred,
 {r('sd_error', 7)} AS sd_error, n FROM curve""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.calibration_curve(v.preds(spark, d)), digits=7)


@query(
    "d22_calibration_slope",
    f"""WITH {CURVE}, b AS (SELECT model, CASE WHEN count(*) > 2 THEN regr_slope(mean_pred, mean_true) END AS bin_slope
 FROM curve GROUP BY model)
SELECT p.model, {r('regr_slope(y_pred, y_true)')} AS slope, {r('regr_intercept(y_pred, y_true)')} AS intercept,
 {r('avg(y_pred) - avg(y_true)')} AS in_the_large, {r('any_value(b.bin_slope)')} AS bin_slope,
 regr_slope(y_pred, y_true) BETWEEN 0.9 AND 1.1 AS slope_ok
FROM pred_long p JOIN b ON p.model = b.model GROUP BY p.model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.calibration_summary(v.preds(spark, d)))


BA = f"""lim AS (SELECT model, avg({E}) AS mean_diff, stddev_samp({E}) AS sd_diff, avg({E}) - 1.96 * stddev_samp({E}) AS loa_lower,
 avg({E}) + 1.96 * stddev_samp({E}) AS loa_upper FROM pred_long GROUP BY model)"""


@query(
    "d23_bland_altman",
    f"""WITH {BA} SELECT p.model, {r('mean_diff')} AS mean_diff, {r('sd_diff')} AS sd_diff, {r('loa_lower')} AS loa_lower,
 {r('loa_upper')} AS loa_upper, count(*) FILTER ({E} BETWEEN loa_lower AND loa_upper) AS n_within,
 {r(f'100.0::DOUBLE * count(*) FILTER ({E} BETWEEN loa_lower AND loa_upper) / count(*)')} AS pct_within
FROM pred_long p JOIN lim l ON p.model = l.model GROUP BY p.model, mean_diff, sd_diff, loa_lower, loa_upper""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.bland_altman(v.preds(spark, d)))


@query(
    "b13_share_within_limits",
    f"""WITH {BA} SELECT p.model, count(*) FILTER ({E} BETWEEN loa_lower AND loa_upper) AS n_within,
 {r(f'100.0::DOUBLE * count(*) FILTER ({E} BETWEEN loa_lower AND loa_upper) / count(*)')} AS pct_within
FROM pred_long p JOIN lim l ON p.model = l.model GROUP BY p.model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.bland_altman(v.preds(spark, d)).select("model", "n_within", "pct_within"))


@query(
    "d24_linear_error_trend",
    f"SELECT model, {r(f'regr_slope({E}, y_true)', 6)} AS c1, {r(f'regr_intercept({E}, y_true)', 6)} AS c0 FROM pred_long GROUP BY model",
    "pred_long",
)
def _(spark, d):
    return rounded(m.polynomial_trend(v.preds(spark, d), 1), digits=6)


@query(
    "d24_quadratic_error_trend",
    f"""WITH c AS (SELECT *, {E} AS e, y_true - avg(y_true) OVER (PARTITION BY model) AS x,
  avg(y_true) OVER (PARTITION BY model) AS m FROM pred_long),
s AS (SELECT model, m, avg(x * x) AS a2, avg(x * x * x) AS a3, avg(x * x * x * x) AS a4, avg(e) AS b0, avg(x * e) AS b1,
  avg(x * x * e) AS b2 FROM c GROUP BY model, m),
q AS (SELECT *, (a2 * (b2 - b0 * a2) - a3 * b1) / (a2 * (a4 - a2 * a2) - a3 * a3) AS q FROM s),
k AS (SELECT *, (b1 - q * a3) / a2 AS b FROM q)
SELECT model, {r('q', 6)} AS c2, {r('b - 2 * q * m', 6)} AS c1, {r('b0 - q * a2 - b * m + q * m * m', 6)} AS c0 FROM k""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.polynomial_trend(v.preds(spark, d), 2), digits=6)


ACCEL = """fit AS (SELECT model, regr_slope(y_pred, y_true) AS a, regr_intercept(y_pred, y_true) AS b FROM pred_long GROUP BY model),
acc AS (SELECT p.*, y_pred - (a * y_true + b) AS acceleration FROM pred_long p JOIN fit f ON p.model = f.model)"""


@query(
    "d25_age_acceleration",
    f"WITH {ACCEL} SELECT model, sample_id, {r('acceleration', 6)} AS acceleration FROM acc",
    "pred_long",
)
def _(spark, d):
    return rounded(m.age_acceleration(v.preds(spark, d)).select("model", "sample_id", "acceleration"), digits=6)


@query(
    "d26_acceleration_classes",
    f"""WITH {ACCEL} SELECT model, {r('avg(acceleration)')} AS mean, {r('stddev_pop(acceleration)')} AS sd,
 {r(f'avg({E})')} AS mean_difference, count(*) FILTER (acceleration < -3) AS n_slow,
 count(*) FILTER (acceleration BETWEEN -3 AND 3) AS n_normal, count(*) FILTER (acceleration > 3) AS n_fast FROM acc GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.acceleration_summary(v.preds(spark, d)))


@query(
    "d32_cv_summary",
    f"""SELECT model, count(*) AS n_folds, {r('avg(mae)')} AS mae_mean, {r('stddev_samp(mae)')} AS mae_sd,
 {r('2.7764451051977987::DOUBLE * stddev_samp(mae) / sqrt(count(*))')} AS mae_ci95, {r('avg(r2)')} AS r2_mean,
 {r('stddev_samp(r2)')} AS r2_sd, {r('2.7764451051977987::DOUBLE * stddev_samp(r2) / sqrt(count(*))')} AS r2_ci95
FROM fold_scores f GROUP BY model""",
    "fold_scores",
)
def _(spark, d):
    return rounded(m.cv_summary(v.fold_scores(spark, d)))


DIFFS = f"""err AS (SELECT model, sample_id, {AE} AS ae FROM pred_long),
best AS (SELECT model FROM err GROUP BY model ORDER BY avg(ae), model LIMIT 1),
diffs AS (SELECT o.model, o.sample_id, b.ae - o.ae AS diff FROM err o JOIN err b ON o.sample_id = b.sample_id
  WHERE b.model = (SELECT model FROM best) AND o.model <> (SELECT model FROM best))"""


def _diffs(spark, d):
    preds = v.preds(spark, d)
    return m.paired_errors(preds, m.best_model(preds))


@query(
    "c10_paired_errors_by_sample",
    f"WITH {DIFFS} SELECT model, sample_id, {r('diff')} AS diff FROM diffs",
    "pred_long",
)
def _(spark, d):
    return rounded(_diffs(spark, d))


@query(
    "d33_paired_t_test",
    f"""WITH {DIFFS} SELECT model, count(*) AS n, {r('avg(diff)')} AS mean_diff,
 {r('avg(diff) / (stddev_samp(diff) / sqrt(count(*)))')} AS t FROM diffs GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.paired_t(_diffs(spark, d)).select("model", "n", "mean_diff", "t"))


@query("d33_paired_t_test_with_p")
def _(spark, d):
    return m.paired_t(_diffs(spark, d))


@query(
    "d34_two_sample_t_test",
    f"""WITH s AS (SELECT model, count(*) FILTER (female = 'True') AS n_a, count(*) FILTER (female = 'False') AS n_b,
 avg({AE}) FILTER (female = 'True') AS mean_a, avg({AE}) FILTER (female = 'False') AS mean_b,
 var_samp({AE}) FILTER (female = 'True') AS var_a, var_samp({AE}) FILTER (female = 'False') AS var_b FROM pred_long GROUP BY model)
SELECT model, n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b,
 {r('(mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b))')} AS t
FROM s""",
    "pred_long",
)
def _(spark, d):
    errs = v.preds(spark, d).withColumn("ae", m.abs_err())
    t = m.two_sample_t(errs, "ae", "female", "True", "False", ["model"])
    return rounded(t.select("model", "n_a", "n_b", "mean_a", "mean_b", "t"))


@query(
    "d35_wilcoxon_signed_rank",
    f"""WITH {DIFFS}, k AS (SELECT model, diff, rank() OVER (PARTITION BY model ORDER BY abs(diff))
  + (count(*) OVER (PARTITION BY model, abs(diff)) - 1) / 2.0::DOUBLE AS rk FROM diffs WHERE diff <> 0)
SELECT model, count(*) AS n, {r('sum(rk) FILTER (diff > 0)')} AS w_plus, {r('sum(rk) FILTER (diff < 0)')} AS w_minus,
 {r('least(sum(rk) FILTER (diff > 0), sum(rk) FILTER (diff < 0))')} AS w FROM k GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.wilcoxon(_diffs(spark, d)).select("model", "n", "w_plus", "w_minus", "w"))


RANKS = """ranks AS (SELECT model, sample_id,
 rank() OVER (PARTITION BY model ORDER BY y_true) + (count(*) OVER (PARTITION BY model, y_true) - 1) / 2.0::DOUBLE AS ra,
 rank() OVER (PARTITION BY model ORDER BY y_pred) + (count(*) OVER (PARTITION BY model, y_pred) - 1) / 2.0::DOUBLE AS rb
 FROM pred_long)"""


@query(
    "d36_spearman",
    f"""WITH {RANKS} SELECT model, count(*) AS n, {r('covar_pop(ra, rb) / (sqrt(var_pop(ra)) * sqrt(var_pop(rb)))')} AS spearman
FROM ranks GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.spearman(v.preds(spark, d)))


@query("w09_average_ranks", f"WITH {RANKS} SELECT model, sample_id, ra AS rank_true FROM ranks", "pred_long")
def _(spark, d):
    ranked = m.average_ranks(v.preds(spark, d).select("model", "sample_id", "y_true"), ["model"], "y_true", ["sample_id"], "rank_true")
    return ranked.select("model", "sample_id", "rank_true")


@query(
    "d37_jarque_bera",
    f"""WITH {MU}, s AS (SELECT model, count(*) AS n, {SKEW} AS skew, avg((e - mu) ** 4) / var_pop(e) ** 2 - 3 AS kurt
 FROM src GROUP BY model)
SELECT model, n, {r('skew')} AS skew, {r('kurt')} AS kurt, {r('n / 6.0::DOUBLE * (skew * skew + kurt * kurt / 4)', 4)} AS jb,
 {r('exp(-(n / 6.0::DOUBLE * (skew * skew + kurt * kurt / 4)) / 2)')} AS p FROM s""",
    "pred_long",
)
def _(spark, d):
    jb = m.jarque_bera(v.preds(spark, d))
    return rounded(rounded(jb, "jb", digits=4), "skew", "kurt", "p")


@query(
    "w01_rolling_bands",
    f"""WITH s AS (SELECT model, sample_id, y_true, {E} AS e FROM pred_long),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY y_true, sample_id) AS rn, count(e) OVER f AS c, avg(e) OVER f AS m,
  stddev_samp(e) OVER f AS s FROM s WINDOW f AS (PARTITION BY model ORDER BY y_true, sample_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
SELECT model, sample_id, rn, {r('CASE WHEN c >= 5 THEN m END', 8)} AS mean, {r('CASE WHEN c >= 5 THEN s END', 8)} AS sd,
 {r('CASE WHEN c >= 5 THEN m - 2 * s END', 8)} AS lower_2sd, {r('CASE WHEN c >= 5 THEN m + 2 * s END', 8)} AS upper_2sd FROM k""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.rolling_bands(v.preds(spark, d)).select("model", "sample_id", "rn", "mean", "sd", "lower_2sd", "upper_2sd"), digits=8)


@query(
    "w02_moving_average",
    f"""WITH s AS (SELECT model, sample_id, y_pred, {E} AS e, row_number() OVER (PARTITION BY model ORDER BY y_pred, sample_id) AS rn,
  count(*) OVER (PARTITION BY model) AS n FROM pred_long),
c AS (SELECT *, greatest(n // 10, 5) AS w, sum(e) OVER (PARTITION BY model ORDER BY rn) AS cs FROM s),
j AS (SELECT a.model, a.sample_id, a.rn, (h.cs - coalesce(l.cs, 0)) / a.w AS smoothed FROM c a
  JOIN c h ON h.model = a.model AND h.rn = a.rn - a.w // 2 - 1 + a.w
  LEFT JOIN c l ON l.model = a.model AND l.rn = a.rn - a.w // 2 - 1 WHERE a.rn - a.w // 2 - 1 >= 0)
SELECT model, sample_id, rn, {r('smoothed', 7)} AS smoothed FROM j""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.moving_average(v.preds(spark, d)).select("model", "sample_id", "rn", "smoothed"), digits=7)


@query(
    "w04_qq_positions",
    f"""SELECT model, sample_id, {r(E)} AS e, row_number() OVER (PARTITION BY model ORDER BY {E}, sample_id) AS rn,
 {r(f"(row_number() OVER (PARTITION BY model ORDER BY {E}, sample_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY model)", 9)} AS position
FROM pred_long""",
    "pred_long",
)
def _(spark, d):
    qq = m.qq_points(v.preds(spark, d))
    return qq.select("model", "sample_id", rd(F.col("e")).alias("e"), "rn", rd(F.col("position"), 9).alias("position"))


@query("w04_qq_points")
def _(spark, d):
    return m.qq_points(v.preds(spark, d)).select("model", "sample_id", "e", "z", "line")


@query(
    "w05_durbin_watson",
    f"""WITH s AS (SELECT model, {E} AS e, lag({E}) OVER (PARTITION BY model ORDER BY sample_id) AS b FROM pred_long)
SELECT model, {r('sum((e - b) * (e - b)) / sum(e * e)')} AS durbin_watson FROM s GROUP BY model""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.durbin_watson(v.preds(spark, d)))


@query(
    "w08_segment_acceleration",
    f"""WITH s AS (SELECT model, {E} AS e, row_number() OVER (PARTITION BY model ORDER BY y_true, sample_id) - 1 AS p,
  count(*) OVER (PARTITION BY model) AS n FROM pred_long)
SELECT model, CAST(i AS BIGINT) AS segment, {r('avg(abs(e))')} AS mean_abs, count(*) AS n FROM s, range(50) t(i)
WHERE p >= i * s.n // 50 AND p <= (i + 1) * s.n // 50 GROUP BY model, i""",
    "pred_long",
)
def _(spark, d):
    return rounded(m.segment_acceleration(v.preds(spark, d)))


@query(
    "x23_diagnostic_labels",
    f"""WITH {MU}, s AS (SELECT model, avg(e) AS bias, {SKEW} AS skew, avg((e - mu) ** 4) / var_pop(e) ** 2 - 3 AS kurt,
 avg(abs(e)) FILTER (split = 'test') / avg(abs(e)) FILTER (split = 'train') AS ratio FROM src GROUP BY model)
SELECT model, CASE WHEN abs(bias) > 0.5 THEN 'biased' ELSE 'unbiased' END AS bias_label,
 CASE WHEN abs(skew) > 0.5 THEN 'skewed' ELSE 'symmetric' END AS skew_label,
 CASE WHEN kurt > 1 THEN 'heavy' ELSE 'normal' END AS tail_label,
 CASE WHEN ratio < 2 THEN 'good' WHEN ratio < 5 THEN 'moderate' ELSE 'severe' END AS overfit_label FROM s""",
    "pred_long",
)
def _(spark, d):
    preds = v.preds(spark, d).withColumn("e", m.err())
    s = preds.groupBy("model").agg(F.avg("e").alias("bias"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurt"))
    s = s.join(m.overfitting(preds), "model")
    return s.select(
        "model",
        F.when(F.abs("bias") > 0.5, "biased").otherwise("unbiased").alias("bias_label"),
        F.when(F.abs("skew") > 0.5, "skewed").otherwise("symmetric").alias("skew_label"),
        F.when(F.col("kurt") > 1, "heavy").otherwise("normal").alias("tail_label"),
        threshold_label("overfitting_ratio", [2.0, 5.0], ["good", "moderate", "severe"]).alias("overfit_label"),
    )
