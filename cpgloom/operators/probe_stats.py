"""Per-probe and per-sample statistics over the long matrix.

Everything is one partial-then-final aggregation: with the matrix clustered by probe the
partial step already leaves about one row per probe and file, whatever the sample count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.sizing import sized

PROBE = "probe_ord"


def sample_moments(cells: DataFrame, value: str = "beta", nan_as_zero: bool = False) -> DataFrame:
    """Mean and population variance per sample; optionally counts missing cells as zero."""
    x = F.coalesce(F.col(value), F.lit(0.0)) if nan_as_zero else F.col(value)
    return cells.groupBy("sample_id").agg(F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))


def probe_moments(cells: DataFrame, value: str = "beta") -> DataFrame:
    return cells.groupBy(PROBE).agg(
        F.count(value).alias("n_present"),
        F.avg(value).alias("mean"),
        F.var_pop(value).alias("variance"),
        (1.0 - F.count(value) / F.count("*")).alias("missing_rate"),
    )


def pearson(value: str = "beta", target: str = "age") -> Column:
    """Aggregate: Pearson r where missing values stand at the group's own mean.

    A cell at the mean adds nothing to the covariance or to the value's variance, so only the
    target's variance runs over all rows.  A zero denominator gives 0.
    """
    n = F.count(value)
    x, y = F.col(value), F.col(target)
    num = n * F.covar_pop(x, y)
    den = F.sqrt(n * F.var_pop(x)) * F.sqrt(F.count(target) * F.var_pop(y))
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def probe_correlation(cells: DataFrame, group: Sequence[str] = (), value: str = "beta", target: str = "age") -> DataFrame:
    """Correlation of every probe with the target, optionally per extra group.

    With groups the missing cells take the probe mean over *all* groups, so the fill no longer
    cancels out and enters through per-group counts.
    """
    if not group:
        return cells.groupBy(PROBE).agg(pearson(value, target).alias("r"))
    x, y = F.col(value), F.col(target)
    parts = cells.groupBy(PROBE, *group).agg(
        F.count("*").alias("n"),
        F.count(x).alias("k"),
        F.avg(x).alias("mx"),
        F.var_pop(x).alias("vx"),
        F.covar_pop(x, y).alias("cxy"),
        F.avg(F.when(x.isNotNull(), y)).alias("my_k"),
        F.avg(y).alias("my"),
        F.var_pop(y).alias("vy"),
    )
    # The fill value is the probe mean over all groups, rebuilt from the group parts.
    fill = parts.groupBy(PROBE).agg(F.try_divide(F.sum(F.col("k") * F.col("mx")), F.sum("k")).alias("fill"))
    k, n = F.col("k"), F.col("n")
    mx = F.coalesce("mx", F.lit(0.0))
    f = F.coalesce("fill", F.lit(0.0))
    mean = (k * mx + (n - k) * f) / n
    ssx = k * F.coalesce("vx", F.lit(0.0)) + k * (mx - mean) * (mx - mean) + (n - k) * (f - mean) * (f - mean)
    # Sum of (x - mean)(y - my): present cells, then filled cells whose y sum is what remains.
    sy_k = k * (F.coalesce("my_k", F.lit(0.0)) - F.col("my"))
    sxy = k * F.coalesce("cxy", F.lit(0.0)) + (mx - f) * sy_k
    r = F.coalesce(F.try_divide(sxy, F.sqrt(ssx) * F.sqrt(n * F.col("vy"))), F.lit(0.0))
    return parts.join(fill, PROBE).select(PROBE, *group, r.alias("r"))


def vector_correlation(left: DataFrame, right: DataFrame, key: str = PROBE, a: str = "r", b: str = "r") -> DataFrame:
    """Correlation of two per-probe vectors matched by probe."""
    pair = left.select(key, F.col(a).alias("a")).join(right.select(key, F.col(b).alias("b")), key)
    den = F.sqrt(F.var_pop("a")) * F.sqrt(F.var_pop("b"))
    return pair.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.covar_pop("a", "b"), den), F.lit(0.0)).alias("r"))


def missing_rate_filter(cells: DataFrame, max_missing_rate: float, value: str = "beta") -> DataFrame:
    """Keep cells of probes whose missing share is at most the limit; a limit <= 0 keeps all."""
    if max_missing_rate <= 0:
        return cells
    keep = (
        cells.groupBy(PROBE)
        .agg((1.0 - F.count(value) / F.count("*")).alias("missing_rate"))
        .where(F.col("missing_rate") <= max_missing_rate)
        .select(PROBE)
    )
    return cells.join(sized(keep), PROBE, "left_semi")


def missingness(cells: DataFrame, value: str = "beta") -> DataFrame:
    """Total, percent, and the worst and mean share of missing cells per sample and per probe."""
    miss = F.avg(F.col(value).isNull().cast("double"))
    total = cells.agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        (miss * 100.0).alias("pct_missing"),
    )
    for key, name in (("sample_id", "sample"), (PROBE, "probe")):
        rate = cells.groupBy(key).agg(miss.alias("m"))
        worst = rate.agg(F.max("m").alias("hi"), F.avg("m").alias("mid"))
        total = total.withColumns(
            {f"max_per_{name}": worst.select("hi").scalar(), f"mean_per_{name}": worst.select("mid").scalar()}
        )
    return total
