"""Leak-free feature selection and preparation for all folds from one scan of the matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.design import feature_arrays
from cpgloom.operators.impute import impute
from cpgloom.operators.ordering import numbered
from cpgloom.operators.probe_stats import PROBE
from cpgloom.operators.scaling import standard_apply, standard_fit
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

# Shifts near the centre of each scale keep differences of sums accurate.
BETA_SHIFT, AGE_SHIFT = 0.5, 50.0


def fold_statistics(cells: DataFrame, value: str = "beta", target: str = "age", fold: str = "fold") -> DataFrame:
    """Per (fold, probe): r, mean and sd over the training rows, i.e. over all other folds.

    One aggregation per (probe, fold); a fold's training sums are the totals minus its own.
    """
    x, y = F.col(value) - BETA_SHIFT, F.col(target) - AGE_SHIFT
    seen = F.when(x.isNotNull(), y)
    parts = cells.groupBy(PROBE, fold).agg(
        F.count("*").alias("n"),
        F.count(x).alias("k"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("sx"),
        F.coalesce(F.sum(x * x), F.lit(0.0)).alias("sxx"),
        F.coalesce(F.sum(x * y), F.lit(0.0)).alias("sxy"),
        F.coalesce(F.sum(seen), F.lit(0.0)).alias("sk"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"),
    )
    names = ["n", "k", "sx", "sxx", "sxy", "sk", "sy", "syy"]
    total = parts.groupBy(PROBE).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    t = parts.join(total, PROBE).select(PROBE, fold, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in names])
    mx = F.try_divide("sx", "k")
    vx = F.greatest(F.col("sxx") - F.coalesce(mx * F.col("sx"), F.lit(0.0)), F.lit(0.0))
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.coalesce(mx * F.col("sk"), F.lit(0.0))
    # Sums of a constant probe cancel to rounding noise; treat that as no spread.
    flat = vx <= 1e-13 * F.greatest(F.col("k"), F.lit(1))
    r = F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)), F.lit(0.0)))
    sd = F.when(flat, F.lit(1.0)).otherwise(F.sqrt(F.try_divide(vx, F.col("k"))))
    return t.select(PROBE, fold, r.alias("r"), (mx + BETA_SHIFT).alias("center"), sd.alias("spread"))


def top_by_fold(stats: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Best k probes of every fold, with rank."""
    usable = stats.where("center is not null")
    return numbered(usable, [fold], [F.abs("r").desc(), PROBE], "rank").where(F.col("rank") <= k)


def fold_designs(cells: DataFrame, k: int, fold: str = "fold", scale: bool = True) -> DataFrame:
    """``(fold, sample_id, own_fold, label, features)``: per held-out fold, all samples prepared by its training rows.

    ``cells``: (sample_id, probe_ord, beta, age, fold).  Mean imputation and standardisation use the
    training mean and sd of that fold; a missing cell therefore becomes 0 after scaling.
    """
    chosen = materialize(top_by_fold(fold_statistics(cells, fold=fold), k, fold), "chosen")
    chosen = chosen.select(F.col(fold).alias("_held"), PROBE, "rank", "center", "spread")
    x = F.coalesce(F.col("beta"), F.col("center"))
    z = (x - F.col("center")) / F.col("spread") if scale else x
    joined = cells.join(sized(chosen), PROBE).withColumn("z", z)
    pairs = F.sort_array(F.collect_list(F.struct(F.col("rank").alias("o"), F.col("z").alias("v"))))
    return joined.groupBy(F.col("_held").alias(fold), "sample_id", F.col(fold).alias("own_fold")).agg(
        F.first("age").alias("label"), F.transform(pairs, lambda p: p["v"]).alias("features")
    )


def train_design(cells: DataFrame, train: DataFrame, chosen: DataFrame, method: str = "mean") -> DataFrame:
    """``(sample_id, features)`` of the chosen probes, imputed and standardised by training rows.

    ``chosen`` has (probe_ord, rank); ``train`` is the part of ``cells`` the statistics come from.
    """
    pick = sized(chosen.select(PROBE, "rank"))
    sub, base = cells.join(pick, PROBE, "left_semi"), train.join(pick, PROBE, "left_semi")
    filled = impute(sub, base, method, empty=0.0)
    fitted = standard_fit(base)
    return feature_arrays(standard_apply(filled, fitted).join(pick, PROBE), "z")
