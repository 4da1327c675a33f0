"""Error metrics and tests over long predictions ``(model, sample_id, y_true, y_pred)``.

Moments come from one aggregation per model with map-side combine.  Order statistics come
from the distributed numbering, never from per-model windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions import distributions as dist
from cpgloom.functions.scalars import p_stars
from cpgloom.operators.ordering import average_ranks, exact_quantiles, framed, numbered, running
from cpgloom.operators.sizing import sized


def err() -> Column:
    """Signed error, prediction minus truth."""
    return F.col("y_pred") - F.col("y_true")


def abs_err() -> Column:
    return F.abs(err())


def r_squared() -> Column:
    """Aggregate: 1 - SSres / SStot, 0 when the truth does not vary."""
    return F.coalesce(1 - F.try_divide(F.sum(err() * err()), F.var_pop("y_true") * F.count("*")), F.lit(0.0))


def pearson_of(a: str = "y_true", b: str = "y_pred") -> Column:
    den = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), den), F.lit(0.0))


def error_metrics(preds: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """n, MAE, median absolute error, RMSE, R2, Pearson and bias per group."""
    group = list(group)
    base = preds.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(abs_err()).alias("mae"),
        F.sqrt(F.avg(err() * err())).alias("rmse"),
        r_squared().alias("r2"),
        pearson_of().alias("correlation"),
        F.avg(err()).alias("bias"),
    )
    med = exact_quantiles(preds.select(*group, abs_err().alias("_ae")), group, "_ae", [0.5], ["mad"])
    return base.join(med, group)


def metrics_rounded(metrics: DataFrame) -> DataFrame:
    """Published precision: 3 decimals for errors, 4 for R2 and correlation."""
    return metrics.withColumns(
        {c: F.round(c, 3) for c in ("mae", "rmse", "mad")} | {c: F.round(c, 4) for c in ("r2", "correlation")}
    )


def metrics_table(preds: DataFrame, n_features: int, fit_seconds: dict[str, float] | None = None) -> DataFrame:
    """One ranked row per model with the columns of the published metrics file."""
    m = error_metrics(preds)
    splits = preds.groupBy("model").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.avg(F.when(F.col("split") == "train", abs_err())).alias("mae_train"),
        F.avg(F.when(F.col("split") == "test", abs_err())).alias("mae_test"),
    )
    secs = F.lit(None).cast("double")
    for name, s in (fit_seconds or {}).items():
        secs = F.when(F.col("model") == name, F.lit(round(s, 2))).otherwise(secs)
    # One row per model.
    by_mae = Window.orderBy("mae", "model")
    return m.join(splits, "model").select(
        F.row_number().over(by_mae).cast("long").alias("rank"),
        "model",
        secs.alias("fit_time_sec"),
        F.lit(n_features).cast("long").alias("n_features"),
        "n_train",
        "n_test",
        "mae",
        "mad",
        "rmse",
        "r2",
        "correlation",
        "mae_train",
        F.try_divide("mae_test", "mae_train").alias("overfitting_ratio"),
    )


def overfitting(preds: DataFrame) -> DataFrame:
    m = preds.groupBy("model").agg(
        F.avg(F.when(F.col("split") == "train", abs_err())).alias("mae_train"),
        F.avg(F.when(F.col("split") == "test", abs_err())).alias("mae_test"),
    )
    return m.withColumn("overfitting_ratio", F.try_divide("mae_test", "mae_train"))


def extended_stats(preds: DataFrame) -> DataFrame:
    """Concordance, shape of the residuals and their linear dependence on age, per model."""
    base = preds.withColumn("e", err()).groupBy("model").agg(
        F.count("*").alias("n"),
        (F.sqrt(F.avg(err() * err())) / F.avg("y_true") * 100).alias("cv_pct"),
        F.try_divide(
            2 * F.covar_pop("y_true", "y_pred"),
            F.var_pop("y_true") + F.var_pop("y_pred") + F.pow(F.avg("y_true") - F.avg("y_pred"), F.lit(2)),
        ).alias("ccc"),
        F.stddev_pop("e").alias("residual_sd"),
        F.skewness("e").alias("skew"),
        F.kurtosis("e").alias("excess_kurtosis"),
        F.regr_slope("e", "y_true").alias("residual_slope"),
        F.regr_intercept("e", "y_true").alias("residual_intercept"),
        F.min("y_true").alias("age_min"),
        F.max("y_true").alias("age_max"),
    )
    q = exact_quantiles(
        preds.select("model", abs_err().alias("_ae")), ["model"], "_ae", [0.25, 0.75], ["q1", "q3"]
    )
    return base.join(q.select("model", (F.col("q3") - F.col("q1")).alias("iqr")), "model")


def mape_icc(preds: DataFrame) -> DataFrame:
    var_e = F.var_pop(err())
    return preds.groupBy("model").agg(
        (F.avg(abs_err() / F.greatest(F.col("y_true"), F.lit(1.0))) * 100).alias("mape"),
        F.try_divide(F.var_pop("y_true"), F.var_pop("y_true") + var_e).alias("icc"),
    )


def calibration_curve(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Mean truth, mean prediction and error spread per quantile bin of the truth."""
    probs = [i / bins for i in range(1, bins)]
    names = [f"_e{i}" for i in range(1, bins)]
    edges = exact_quantiles(preds, ["model"], "y_true", probs, names)
    edges = edges.select("model", F.array(*names).alias("_edges"))
    binned = preds.join(sized(edges), "model").withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e <= F.col("y_true"))).cast("long")
    )
    return binned.groupBy("model", "bin").agg(
        F.avg("y_true").alias("mean_true"),
        F.avg("y_pred").alias("mean_pred"),
        F.coalesce(F.stddev_samp(err()), F.lit(0.0)).alias("sd_error"),
        F.count("*").alias("n"),
    )


def calibration_summary(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Slope and intercept of prediction on truth, mean offset, slope verdict, slope over bins."""
    base = preds.groupBy("model").agg(
        F.regr_slope("y_pred", "y_true").alias("slope"),
        F.regr_intercept("y_pred", "y_true").alias("intercept"),
        (F.avg("y_pred") - F.avg("y_true")).alias("in_the_large"),
    )
    curve = calibration_curve(preds, bins).groupBy("model").agg(
        F.when(F.count("*") > 2, F.regr_slope("mean_pred", "mean_true")).alias("bin_slope")
    )
    return base.join(curve, "model").withColumn("slope_ok", F.col("slope").between(0.9, 1.1))


def bland_altman(preds: DataFrame) -> DataFrame:
    """Mean difference, 95 % limits of agreement and the share of samples within them."""
    lim = preds.groupBy("model").agg(F.avg(err()).alias("mean_diff"), F.stddev_samp(err()).alias("sd_diff"))
    lim = lim.withColumns(
        {
            "loa_lower": F.col("mean_diff") - 1.96 * F.col("sd_diff"),
            "loa_upper": F.col("mean_diff") + 1.96 * F.col("sd_diff"),
        }
    )
    inside = err().between(F.col("loa_lower"), F.col("loa_upper"))
    return (
        preds.join(sized(lim), "model")
        .groupBy("model", "mean_diff", "sd_diff", "loa_lower", "loa_upper")
        .agg(F.count_if(inside).alias("n_within"), (F.avg(inside.cast("double")) * 100).alias("pct_within"))
    )


def polynomial_trend(preds: DataFrame, degree: int = 2) -> DataFrame:
    """Least-squares trend of the error on age, solved from power sums (centred at the mean age)."""
    mid = preds.groupBy("model").agg(F.avg("y_true").alias("m"))
    x, e = F.col("x"), err()
    s = (
        preds.join(sized(mid), "model")
        .withColumn("x", F.col("y_true") - F.col("m"))
        .groupBy("model", "m")
        .agg(
            F.avg(x * x).alias("s2"),
            F.avg(x * x * x).alias("s3"),
            F.avg(x * x * x * x).alias("s4"),
            F.avg(e).alias("t0"),
            F.avg(x * e).alias("t1"),
            F.avg(x * x * e).alias("t2"),
        )
    )
    m, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("m", "s2", "s3", "s4", "t0", "t1", "t2"))
    if degree == 1:
        b = F.try_divide(t1, s2)
        return s.select("model", b.alias("c1"), (t0 - b * m).alias("c0"))
    # With x centred the normal equations reduce to two unknowns.
    det = s2 * (s4 - s2 * s2) - s3 * s3
    q = F.try_divide(s2 * (t2 - t0 * s2) - s3 * t1, det)
    b = F.try_divide(t1 - q * s3, s2)
    a = t0 - q * s2
    return s.select("model", q.alias("c2"), (b - 2 * q * m).alias("c1"), (a - b * m + q * m * m).alias("c0"))


def age_acceleration(preds: DataFrame) -> DataFrame:
    """Residual of the regression of prediction on truth, per sample."""
    fit = preds.groupBy("model").agg(
        F.regr_slope("y_pred", "y_true").alias("_a"), F.regr_intercept("y_pred", "y_true").alias("_b")
    )
    accel = F.col("y_pred") - (F.col("_a") * F.col("y_true") + F.col("_b"))
    return preds.join(sized(fit), "model").withColumn("acceleration", accel).drop("_a", "_b")


def acceleration_summary(preds: DataFrame, limit: float = 3.0) -> DataFrame:
    a = F.col("acceleration")
    return age_acceleration(preds).groupBy("model").agg(
        F.avg(a).alias("mean"),
        F.stddev_pop(a).alias("sd"),
        F.avg(err()).alias("mean_difference"),
        F.count_if(a < -limit).alias("n_slow"),
        F.count_if(a.between(-limit, limit)).alias("n_normal"),
        F.count_if(a > limit).alias("n_fast"),
    )


def cv_summary(folds: DataFrame, metrics: Sequence[str] = ("mae", "r2")) -> DataFrame:
    """Mean, sample sd and half-width of the 95 % t interval per model over its folds."""
    aggs = [F.count("*").alias("n_folds")]
    for m in metrics:
        half = dist.t_975(F.count(m) - 1) * F.stddev_samp(m) / F.sqrt(F.count(m))
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), half.alias(f"{m}_ci95")]
    return folds.groupBy("model").agg(*aggs).orderBy(f"{metrics[0]}_mean")


def paired_errors(preds: DataFrame, best: str) -> DataFrame:
    """Difference of absolute errors, best model minus each other one, matched by sample."""
    errs = preds.select("model", "sample_id", abs_err().alias("ae"))
    ref = errs.where(F.col("model") == best).select("sample_id", F.col("ae").alias("best_ae"))
    return (
        errs.where(F.col("model") != best)
        .join(ref, "sample_id")
        .select("model", "sample_id", (F.col("best_ae") - F.col("ae")).alias("diff"))
    )


def best_model(preds: DataFrame) -> str:
    """Name of the model with the lowest MAE (one value to the driver)."""
    return preds.groupBy("model").agg(F.avg(abs_err()).alias("mae")).orderBy("mae", "model").first()["model"]


def paired_t(diffs: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    n = F.count("*")
    t = diffs.groupBy(*group).agg(
        n.alias("n"),
        F.avg("diff").alias("mean_diff"),
        F.try_divide(F.avg("diff"), F.stddev_samp("diff") / F.sqrt(n)).alias("t"),
    )
    return t.withColumn("p", dist.t_pvalue("t", (F.col("n") - 1).cast("double"))).withColumn(
        "significant", F.col("p") < 0.05
    )


def two_sample_t(df: DataFrame, value: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """Pooled-variance t test of two categories of ``group``."""
    x = F.col(value)

    def part(fn, v):
        return fn(F.when(F.col(group) == v, x))

    m = df.groupBy(*by).agg(
        part(F.count, a).alias("n_a"), part(F.count, b).alias("n_b"),
        part(F.avg, a).alias("mean_a"), part(F.avg, b).alias("mean_b"),
        part(F.var_samp, a).alias("var_a"), part(F.var_samp, b).alias("var_b"),
    )
    df_ = F.col("n_a") + F.col("n_b") - 2
    pooled = F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), df_)
    se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), "n_a") + F.try_divide(F.lit(1.0), "n_b")))
    out = m.withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), se))
    out = out.withColumn("p", dist.t_pvalue("t", df_.cast("double")))
    return out.select(*by, "n_a", "n_b", "mean_a", "mean_b", "t", "p", p_stars("p").alias("stars"))


def wilcoxon(diffs: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Signed-rank statistic with zeros dropped and averaged ties; normal approximation for p."""
    group = list(group)
    rows = numbered(
        diffs.where("diff <> 0").select(*group, "sample_id", "diff", F.abs("diff").alias("a")),
        group,
        ["a", "sample_id"],
        "_rn",
    )
    ties = rows.groupBy(*group, "a").agg(
        F.avg("_rn").alias("rank"),
        F.count_if(F.col("diff") > 0).alias("pos"),
        F.count_if(F.col("diff") < 0).alias("neg"),
    )
    c = (F.col("pos") + F.col("neg")).cast("double")
    w = ties.groupBy(*group).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum(F.col("rank") * F.col("pos")).alias("w_plus"),
        F.sum(F.col("rank") * F.col("neg")).alias("w_minus"),
        F.sum(c * c * c - c).alias("_ties"),
    )
    n = F.col("n").cast("double")
    stat = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.try_divide(stat - n * (n + 1) / 4, F.sqrt(var))
    return w.withColumns({"w": stat, "z": z}).withColumn("p", dist.normal_pvalue("z")).drop("_ties")


def spearman(preds: DataFrame, a: str = "y_true", b: str = "y_pred", group: Sequence[str] = ("model",)) -> DataFrame:
    group = list(group)
    slim = preds.select(*group, "sample_id", a, b)
    ranked = average_ranks(average_ranks(slim, group, a, ["sample_id"], "_ra"), group, b, ["sample_id"], "_rb")
    return ranked.groupBy(*group).agg(F.count("*").alias("n"), pearson_of("_ra", "_rb").alias("spearman"))


def jarque_bera(preds: DataFrame) -> DataFrame:
    m = preds.withColumn("e", err()).groupBy("model").agg(
        F.count("*").alias("n"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurt")
    )
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return m.withColumn("jb", jb).withColumn("p", F.exp(-F.col("jb") / 2))


def durbin_watson(preds: DataFrame) -> DataFrame:
    """Sum of squared steps of the error over its sum of squares, in sample order."""
    rows = numbered(preds.select("model", "sample_id", err().alias("e")), ["model"], ["sample_id"])
    steps = framed(rows, ["model"], "rn", 1, 0, {"before": lambda w: F.lag("e").over(w)})
    d = F.col("e") - F.col("before")
    return steps.groupBy("model").agg(F.try_divide(F.sum(d * d), F.sum(F.col("e") * F.col("e"))).alias("durbin_watson"))


def rolling_bands(preds: DataFrame, window: int = 20, min_periods: int = 5) -> DataFrame:
    """Centred rolling mean and sd of the error along age with one and two sd bands."""
    rows = numbered(preds.select("model", "sample_id", "y_true", err().alias("e")), ["model"], ["y_true", "sample_id"])
    before, after = window // 2, window - 1 - window // 2

    def enough(fn):
        def over(w):
            frame = w.rowsBetween(-before, after)
            return F.when(F.count("e").over(frame) >= min_periods, fn("e").over(frame))

        return over

    out = framed(rows, ["model"], "rn", before, after, {"mean": enough(F.avg), "sd": enough(F.stddev_samp)})
    bands = {f"{s}_{k}sd": F.col("mean") + q * k * F.col("sd") for s, q in (("lower", -1), ("upper", 1)) for k in (1, 2)}
    return out.withColumns(bands)


def moving_average(preds: DataFrame, parts: int = 10, smallest: int = 5) -> DataFrame:
    """Mean error over full frames of max(n div parts, smallest) rows along the prediction.

    The frame grows with the data, so it is read off a running sum: two equi-joins on the row
    number instead of re-adding a tenth of the model for every row.
    """
    rows = numbered(
        preds.select("model", "sample_id", "y_pred", err().alias("e")), ["model"], ["y_pred", "sample_id"], "rn", "n"
    )
    rows = rows.withColumn("w", F.greatest(F.floor(F.col("n") / parts), F.lit(smallest)).cast("long"))
    sums = running(rows, ["model"], "rn", "e", "s")
    head = F.col("rn") - F.floor(F.col("w") / 2) - 1
    here = rows.withColumns({"lo": head.cast("long"), "hi": (head + F.col("w")).cast("long")}).where(
        "lo >= 0 and hi <= n"
    )
    ends = sums.select("model", F.col("rn").alias("hi"), F.col("s").alias("s_hi"))
    starts = sums.select("model", F.col("rn").alias("lo"), F.col("s").alias("s_lo"))
    total = F.col("s_hi") - F.coalesce(F.col("s_lo"), F.lit(0.0))
    return (
        here.join(ends, ["model", "hi"])
        .join(starts, ["model", "lo"], "left")
        .select("model", "sample_id", "rn", "y_pred", "e", (total / F.col("w")).alias("smoothed"))
    )


def qq_points(preds: DataFrame) -> DataFrame:
    """Sorted error against the normal quantile of its plotting position, with the mean + sd * z line."""
    fit = preds.groupBy("model").agg(F.avg(err()).alias("mu"), F.stddev_pop(err()).alias("sigma"))
    rows = numbered(preds.select("model", "sample_id", err().alias("e")), ["model"], ["e", "sample_id"], "rn", "n")
    rows = rows.withColumn("position", (F.col("rn") - 0.5) / F.col("n")).join(sized(fit), "model")
    return rows.withColumn("z", dist.normal_quantile("position")).withColumn(
        "line", F.col("mu") + F.col("sigma") * F.col("z")
    )


def segment_acceleration(preds: DataFrame, segments: int = 50) -> DataFrame:
    """Mean absolute difference per equal-count stretch along age; neighbours share one row."""
    rows = numbered(preds.select("model", "sample_id", "y_true", err().alias("e")), ["model"], ["y_true", "sample_id"], "rn", "n")
    p, n = F.col("rn") - 1, F.col("n")
    near = F.sequence(
        F.greatest(F.lit(0), F.floor(p * segments / n) - 1).cast("long"),
        F.least(F.lit(segments - 1), F.floor((p + 1) * segments / n) + 1).cast("long"),
    )
    s = F.col("segment")
    inside = (p >= F.floor(s * n / segments)) & (p <= F.floor((s + 1) * n / segments))
    return (
        rows.withColumn("segment", F.explode(near))
        .where(inside)
        .groupBy("model", "segment")
        .agg(F.avg(F.abs("e")).alias("mean_abs"), F.count("*").alias("n"))
    )
