"""Scalers fitted on training cells and applied to any cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.probe_stats import PROBE
from cpgloom.operators.sizing import sized


def standard_fit(train_cells: DataFrame, value: str = "beta") -> DataFrame:
    """Mean and population sd per probe; a constant probe is only centred."""
    sd = F.stddev_pop(value)
    return train_cells.groupBy(PROBE).agg(
        F.avg(value).alias("center"), F.when(sd > 0, sd).when(sd.isNotNull(), F.lit(1.0)).alias("spread")
    )


def standard_apply(cells: DataFrame, fitted: DataFrame, value: str = "beta", out: str = "z") -> DataFrame:
    z = (F.col(value) - F.col("center")) / F.col("spread")
    return cells.join(sized(fitted), PROBE).withColumn(out, z).drop("center", "spread")


def global_min_max(cells: DataFrame, train_cells: DataFrame, value: str = "beta", out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min + 1e-8) with the bounds of all training cells."""
    span = train_cells.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return cells.withColumn(out, (F.col(value) - lo) / (hi - lo + 1e-8))
