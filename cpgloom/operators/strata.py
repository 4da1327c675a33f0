"""Breakdowns of predictions by category, band, batch and model, and their chart datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions.scalars import bin_by, chip_id
from cpgloom.operators.metrics import abs_err, err
from cpgloom.operators.ordering import exact_quantiles, numbered
from cpgloom.operators.sizing import sized


def frequency(df: DataFrame, col: str) -> DataFrame:
    """Count and percent share per value."""
    counts = df.groupBy(col).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).select("n").scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def describe(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample sd, minimum, exact quartiles and maximum."""
    group = list(group)
    base = df.groupBy(*group).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    if group:
        return base.join(q, group, "left")
    return base.withColumns({c: q.select(c).scalar() for c in ("q25", "q50", "q75")})


def mae_by(preds: DataFrame, *keys: str) -> DataFrame:
    return preds.groupBy(*keys).agg(F.avg(abs_err()).alias("mae"), F.count("*").alias("n")).orderBy("mae", *keys)


def mae_spread_by_band(preds: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    banded = preds.withColumn("age_group", bin_by("y_true", edges, labels)).where("age_group is not null")
    return banded.groupBy("model", "age_group").agg(
        F.avg(abs_err()).alias("mae"), F.stddev_samp(abs_err()).alias("sd"), F.count("*").alias("n")
    )


def sunburst(preds: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Count and MAE for every prefix of the level hierarchy; the grand total has null levels."""
    return preds.rollup(*levels).agg(
        F.avg(abs_err()).alias("mae"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level_id")
    )


def config_pivot(trials: DataFrame, models: Sequence[str]) -> DataFrame:
    """Mean test error per configuration and model, with the row mean over the models present."""
    keyed = trials.withColumn("config", F.concat_ws("_", "strategy", "n_features"))
    wide = keyed.groupBy("config").pivot("model_name", list(models)).agg(F.avg("mae_test"))
    seen = F.filter(F.array(*[F.col(m) for m in models]), lambda x: x.isNotNull())
    mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)
    return wide.withColumn("row_mean", mean).orderBy("row_mean", "config")


def model_agreement(preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per sample: each model's prediction, their mean and sd, and the true age."""
    picks = [F.max(F.when(F.col("model") == m, F.col("y_pred"))).alias(m) for m in models]
    return preds.groupBy("sample_id").agg(
        *picks, F.avg("y_pred").alias("mean"), F.stddev_samp("y_pred").alias("sd"), F.min("y_true").alias("y_true")
    )


def best_trial(trials: DataFrame, keys: Sequence[str], by: str = "mae_test", tie: str = "trial_id") -> DataFrame:
    """The row with the lowest ``by`` per key; an aggregate, so no key is sorted in one task."""
    rest = [c for c in trials.columns if c not in keys]
    first = F.min(F.struct(by, tie, *[c for c in rest if c not in (by, tie)])).alias("_best")
    return trials.groupBy(*keys).agg(first).select(*keys, "_best.*")


def batch_effect(preds: DataFrame, min_size: int = 3) -> DataFrame:
    """Mean, sd and count of the error per chip with enough samples."""
    chips = preds.withColumn("chip", chip_id("sample_description")).groupBy("model", "chip")
    return chips.agg(F.avg(err()).alias("mean"), F.stddev_samp(err()).alias("sd"), F.count("*").alias("n")).where(
        F.col("n") >= min_size
    )


def batch_spread(preds: DataFrame, min_size: int = 3) -> DataFrame:
    """Spread of the chip means per model; needs two chips."""
    return (
        batch_effect(preds, min_size)
        .groupBy("model")
        .agg(F.count("*").alias("n_chips"), F.stddev_samp("mean").alias("inter_batch_sd"))
        .where("n_chips >= 2")
    )


def large_groups(df: DataFrame, key: Column, min_size: int = 3, min_groups: int = 2) -> DataFrame:
    """Rows of groups with enough members; nothing when too few such groups exist."""
    keyed = df.withColumn("_key", key)
    groups = keyed.groupBy("_key").count().where(F.col("count") >= min_size).select("_key")
    enough = groups.agg(F.count("*").alias("c")).select("c").scalar() >= min_groups
    return keyed.join(sized(groups), "_key", "left_semi").where(enough).drop("_key")


def histogram(df: DataFrame, value: str, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts and densities between minimum and maximum; the last bin is closed."""
    group = list(group)
    span = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    if group:
        ranged = df.join(sized(span), group)
    else:
        ranged = df.withColumns({c: span.select(c).scalar() for c in ("_lo", "_hi", "_n")})
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), width)), F.lit(0))
    slot = F.least(at, F.lit(bins - 1)).cast("long")
    counts = ranged.where(F.col(value).isNotNull()).groupBy(*group, slot.alias("bin"), "_lo", "_hi", "_n")
    return counts.agg(F.count("*").alias("n")).select(
        *group,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("left_edge"),
        "n",
        F.try_divide(F.col("n") / F.col("_n"), width).alias("density"),
    )


def density_grid(df: DataFrame, x: str, y: str, bins: int, group: str = "model") -> DataFrame:
    """Two-dimensional counts on an equal-width grid."""
    span = df.groupBy(group).agg(*[f(c).alias(f"_{k}_{c}") for c in (x, y) for k, f in (("lo", F.min), ("hi", F.max))])
    ranged = df.join(sized(span), group)

    def slot(c):
        width = (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / bins
        at = F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), width)), F.lit(0))
        return F.least(at, F.lit(bins - 1)).cast("long")

    return ranged.groupBy(group, slot(x).alias("x_bin"), slot(y).alias("y_bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and the number of outliers per group."""
    group = list(group)
    q = exact_quantiles(df, group, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    x, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        df.where(x.isNotNull())
        .join(sized(q), group)
        .groupBy(*group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def models_by_median_error(preds: DataFrame) -> DataFrame:
    slim = preds.select("model", abs_err().alias("_ae"))
    return exact_quantiles(slim, ["model"], "_ae", [0.5], ["median_abs_error"]).orderBy(
        "median_abs_error", "model"
    )


def kde(df: DataFrame, value: str, group: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth.

    Equal values are counted first, which collapses hot values and spreads the rest over the
    shuffle partitions; the rows then fan out over the fixed grid and are summed map-side, so
    the second shuffle carries at most ``points`` rows per group and task.
    """
    x = F.col(value)
    counted = df.where(x.isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    s = df.groupBy(group).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.stddev_samp(x).alias("_sd"), F.count(x).alias("_n")
    )
    s = s.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    grid = F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))
    at = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    z = (at - x) / F.col("_h")
    norm = F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi())
    return (
        counted.join(sized(s), group)
        .withColumn("point", F.explode(grid))
        .groupBy(group, "point", "_lo", "_hi", "_n", "_h")
        .agg(F.sum(F.col("_c") * F.exp(-z * z / 2)).alias("_k"))
        .select(group, "point", at.alias("x"), (F.col("_k") / norm).alias("density"))
    )


def stream_cells(preds: DataFrame, models: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Signed error counts and means for every (model, age bin), empty cells as zeros."""
    lows = [float(e) for e in edges[:-1]]
    e = err()
    seen = (
        preds.where(F.col("model").isin(*models))
        .withColumn("age_bin", bin_by("y_true", edges, lows))
        .where("age_bin is not null")
        .groupBy("age_bin", "model")
        .agg(
            F.count_if(e > 0).alias("pos_count"),
            F.count_if(e < 0).alias("neg_count"),
            F.avg(F.when(e > 0, e)).alias("pos_mean"),
            F.avg(F.when(e < 0, e)).alias("neg_mean"),
            F.count("*").alias("total"),
            F.avg(F.abs(e)).alias("mae"),
        )
    )
    grid = densify(preds.sparkSession.range(1), models, lows)
    filled = grid.join(seen, ["model", "age_bin"], "left")
    measures = [c for c in seen.columns if c not in ("model", "age_bin")]
    return filled.select("model", "age_bin", *[F.coalesce(c, F.lit(0)).alias(c) for c in measures])


def densify(one_row: DataFrame, models: Sequence[str], values: Sequence) -> DataFrame:
    """Every (model, bin) of two fixed lists, expanded from a one-row frame."""
    return one_row.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model")).select(
        "model", F.explode(F.array(*[F.lit(x) for x in values])).alias("age_bin")
    )


def affinity(preds: DataFrame, models: Sequence[str], category: str = "ethnicity") -> DataFrame:
    """max(0, 10 - MAE) * n / 50 per (category, model), zero where a pair has no rows."""
    mae, n = F.avg(abs_err()), F.count("*")
    seen = preds.groupBy(category, "model").agg((F.greatest(F.lit(0.0), 10 - mae) * n / 50).alias("weight"))
    wide = seen.groupBy(category).pivot("model", list(models)).agg(F.first("weight"))
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.coalesce(m, F.lit(0.0)).alias("weight")) for m in models])
    return wide.select(category, F.explode(pairs).alias("_p")).select(category, "_p.*")


def normalise_metrics(metrics: DataFrame, lower_better: Sequence[str], higher_better: Sequence[str]) -> DataFrame:
    """Scores in [0, 1] per metric across models (one row per model), inverted where lower is better."""
    every = Window.partitionBy(F.lit(0))
    cols = {}
    for c in [*lower_better, *higher_better]:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        share = (F.col(c) - lo) / (hi - lo + 0.001)
        cols[c] = 1 - share if c in lower_better else share
    return metrics.select("model", *[col.alias(name) for name, col in cols.items()])


def error_correlations(preds: DataFrame, models: Sequence[str]) -> DataFrame:
    """Pearson matrix of the models' predictions and the truth, in long form.

    One shuffle puts the models of a sample side by side; all pairs then come from one global
    aggregation with a fixed number of moments.
    """
    wide = model_agreement(preds, models)
    names = [*models, "y_true"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        den = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
        aggs.append(F.coalesce(F.try_divide(F.covar_pop(a, b), den), F.lit(0.0)).alias(f"_{i}"))
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{i}").alias("r")))
    return wide.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def improvement_by_fold(folds: DataFrame, base: str, other: str) -> DataFrame:
    """MAE of two models per fold, the gain of the second and its percent."""
    a = F.max(F.when(F.col("model") == base, F.col("mae")))
    b = F.max(F.when(F.col("model") == other, F.col("mae")))
    wide = folds.groupBy("fold").agg(a.alias("base_mae"), b.alias("other_mae"))
    gain = F.col("base_mae") - F.col("other_mae")
    return wide.withColumns({"delta": gain, "pct": F.try_divide(gain * 100, "base_mae")})


def bias_by_band(preds: DataFrame, models: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Bias and MAE per age band with one column pair per model; empty bands are absent."""
    labels = [f"{int(a)}-{int(b)}" for a, b in zip(edges, edges[1:])]
    banded = preds.withColumn("band", bin_by("y_true", edges, labels)).where("band is not null")
    picks = [F.count("*").alias("n")]
    for m in models:
        mine = F.col("model") == m
        picks += [F.avg(F.when(mine, err())).alias(f"bias_{m}"), F.avg(F.when(mine, abs_err())).alias(f"mae_{m}")]
    return banded.where(F.col("model").isin(*models)).groupBy("band").agg(*picks)


def signed_outliers(preds: DataFrame) -> DataFrame:
    e = err()
    return preds.groupBy("model").agg(
        F.count_if(e > 0).alias("n_over"),
        F.count_if(e < 0).alias("n_under"),
        F.avg(F.when(e > 0, e)).alias("mean_over"),
        F.avg(F.when(e < 0, e)).alias("mean_under"),
    )


def percentile_cut(df: DataFrame, value: str, p: float) -> DataFrame:
    """Rows whose absolute value lies above the p-quantile of the absolute values."""
    sized_up = df.withColumn("_abs", F.abs(value))
    cut = exact_quantiles(sized_up, [], "_abs", [p], ["cut"])
    return sized_up.where(F.col("_abs") > cut.select("cut").scalar()).drop("_abs")


def inverse_error_ensemble(preds: DataFrame, max_mae: float = 10.0) -> DataFrame:
    """Per sample: plain mean, 1/MAE-weighted mean, and mean over models below the error limit."""
    mae = preds.groupBy("model").agg(F.avg(abs_err()).alias("mae"))
    w = F.col("w")
    return (
        preds.join(sized(mae), "model")
        .withColumn("w", F.try_divide(F.lit(1.0), "mae"))
        .groupBy("sample_id")
        .agg(
            F.min("y_true").alias("y_true"),
            F.avg("y_pred").alias("simple"),
            F.try_divide(F.sum(w * F.col("y_pred")), F.sum(w)).alias("weighted"),
            F.avg(F.when(F.col("mae") < max_mae, F.col("y_pred"))).alias("selected"),
        )
    )


def waterfall(metrics: DataFrame, exclude: str = "AltumAge") -> DataFrame:
    """Models by MAE with the step from the one before (one row per model)."""
    order = Window.partitionBy(F.lit(0)).orderBy("mae", "model")
    step = F.col("mae") - F.coalesce(F.lag("mae").over(order), F.lit(0.0))
    return metrics.where(~F.col("model").eqNullSafe(exclude)).select(
        F.row_number().over(order).cast("long").alias("position"), "model", "mae", step.alias("step")
    )


def trial_summary(trials: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """Totals over all trials plus the best model of each family and of all."""
    best = F.min_by("model_name", F.struct("mae_test", "trial_id"))
    aggs = [
        F.count("*").alias("n"),
        F.min("mae_test").alias("best_mae"),
        F.max("mae_test").alias("worst_mae"),
        F.avg("mae_test").alias("mean_mae"),
        F.sum("time_min").alias("total_min"),
        (F.sum("time_min") / 60).alias("total_h"),
        F.count_if(F.col("overfitting_ratio") < 2).alias("n_ratio_below_2"),
        F.count_if(F.col("overfitting_ratio") < 3).alias("n_ratio_below_3"),
        F.count_if(F.col("overfitting_ratio") > 5).alias("n_ratio_above_5"),
        best.alias("best_model"),
    ]
    for name, members in families.items():
        mine = F.col("model_name").isin(*members)
        aggs.append(F.min(F.when(mine, F.col("mae_test"))).alias(f"best_{name}"))
    return trials.agg(*aggs)


def range_normalise(df: DataFrame, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min) with the bounds as scalar subqueries instead of a global window."""
    span = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return df.withColumn(out, F.try_divide(F.col(col) - lo, hi - lo))


def factorize(df: DataFrame, col: str, order: str, out: str) -> DataFrame:
    """0-based code per value in order of first appearance."""
    firsts = df.groupBy(col).agg(F.min(order).alias("_first"))
    codes = numbered(firsts, [], ["_first", col], "_code").withColumn(out, (F.col("_code") - 1).cast("long")).drop("_code")
    return df.join(sized(codes.drop("_first")), col)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order, as an aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    head = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(head).select(*keys, "_first.*")


def distinct_in_order(df: DataFrame, col: str, order: str) -> DataFrame:
    return df.groupBy(col).agg(F.min(order).alias("first_at")).orderBy("first_at")
