"""Linear clocks: scoring, calibration, stacking inputs and robustness to missing probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cpgloom.functions.scalars import clock_to_age
from cpgloom.operators.sizing import sized


def score_clocks(cells: DataFrame, coefs: DataFrame, transformed: Sequence[str] = (), value: str = "beta") -> DataFrame:
    """``(sample_id, clock, y_pred)``: intercept plus weighted sum over the probes present.

    ``cells`` carries ``probe_id``; clocks named in ``transformed`` predict on the log-linear age
    scale and are mapped back to years.
    """
    raw = (
        cells.join(sized(coefs.select("clock", "probe_id", "coef", "intercept")), "probe_id")
        .groupBy("sample_id", "clock")
        .agg((F.first("intercept") + F.coalesce(F.sum(F.col("coef") * F.col(value)), F.lit(0.0))).alias("y_pred"))
    )
    if not transformed:
        return raw
    back = F.when(F.col("clock").isin(*transformed), clock_to_age("y_pred")).otherwise(F.col("y_pred"))
    return raw.withColumn("y_pred", back)


def calibrate(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """Out-of-fold linear recalibration per clock.

    The line for a held-out fold comes from all rows minus that fold: central moments per
    (clock, fold) are merged to totals and one fold is taken out again, so one aggregation
    serves every fold.
    """
    x, y = F.col("y_pred"), F.col("y_true")
    n = F.count("*")
    parts = scored.groupBy("clock", fold).agg(
        n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (n * F.var_pop(x)).alias("cxx"), (n * F.covar_pop(x, y)).alias("cxy")
    )
    per_clock = Window.partitionBy("clock")  # one row per fold
    total = F.sum("n").over(per_clock)
    parts = parts.withColumns(
        {
            "tn": total,
            "tx": F.sum(F.col("n") * F.col("mx")).over(per_clock) / total,
            "ty": F.sum(F.col("n") * F.col("my")).over(per_clock) / total,
        }
    )
    dx, dy = F.col("mx") - F.col("tx"), F.col("my") - F.col("ty")
    parts = parts.withColumns(
        {
            "txx": F.sum(F.col("cxx") + F.col("n") * dx * dx).over(per_clock),
            "txy": F.sum(F.col("cxy") + F.col("n") * dx * dy).over(per_clock),
        }
    )
    # Leaving the fold out moves the means by n / rest of the fold's own offset.
    rest = F.col("tn") - F.col("n")
    moved = F.col("n") * F.col("tn") / rest
    slope = F.try_divide(F.col("txy") - F.col("cxy") - moved * dx * dy, F.col("txx") - F.col("cxx") - moved * dx * dx)
    lines = parts.where(rest > 0).select(
        "clock", fold, slope.alias("slope"), (F.col("tx") - F.col("n") / rest * dx).alias("rx"), (F.col("ty") - F.col("n") / rest * dy).alias("ry")
    )
    fitted = F.col("ry") + F.col("slope") * (x - F.col("rx"))
    return scored.join(sized(lines), ["clock", fold]).withColumn("calibrated", fitted).drop("slope", "rx", "ry")


def calibration_gain(calibrated: DataFrame) -> DataFrame:
    raw, cal = F.col("y_pred") - F.col("y_true"), F.col("calibrated") - F.col("y_true")
    return calibrated.groupBy("clock").agg(
        F.avg(F.abs(raw)).alias("mae_raw"),
        F.avg(F.abs(cal)).alias("mae_calibrated"),
        F.avg(raw).alias("bias_raw"),
        F.avg(cal).alias("bias_calibrated"),
    )


def robustness(
    test_cells: DataFrame, coefs: DataFrame, intercept: float, rates: Sequence[float], iterations: int = 30, value: str = "beta"
) -> DataFrame:
    """Error of a linear score when a share of the probes falls back to its training mean.

    ``test_cells``: (sample_id, probe_ord, y_true, value); ``coefs``: (probe_ord, coef, center).
    Cells are masked by a hash of sample, probe and repetition.  All rates share that hash and are
    separate sums of the same rows, so only the repetitions multiply the input.
    """
    text = F.concat_ws("|", "sample_id", F.col("probe_ord").cast("string"), F.col("iteration").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = (
        test_cells.join(sized(coefs), "probe_ord")
        .withColumn("iteration", F.explode(F.array(*[F.lit(i).cast("long") for i in range(iterations)])))
        .withColumn("_u", draw)
    )
    x = F.coalesce(F.col(value), F.col("center"))
    sums = [F.sum(F.col("coef") * F.when(F.col("_u") < r, F.col("center")).otherwise(x)).alias(f"_s{i}") for i, r in enumerate(rates)]
    preds = rows.groupBy("sample_id", "iteration").agg(F.first("y_true").alias("y_true"), *sums)
    errors = [F.avg(F.abs(F.col(f"_s{i}") + intercept - F.col("y_true"))).alias(f"_e{i}") for i in range(len(rates))]
    pairs = F.array(*[F.struct(F.lit(float(r)).alias("missing_rate"), F.col(f"_e{i}").alias("mae")) for i, r in enumerate(rates)])
    per = preds.groupBy("iteration").agg(*errors).select("iteration", F.explode(pairs).alias("p")).select("iteration", "p.*")
    # ``iterations`` values per rate: the exact median buffer stays that small.
    return per.groupBy("missing_rate").agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.percentile("mae", F.lit(0.5)).alias("mae_median")
    )
