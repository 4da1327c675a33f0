"""Feature selection and deterministic sampling over the long matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.ordering import numbered
from cpgloom.operators.probe_stats import PROBE, pearson, probe_correlation
from cpgloom.operators.sizing import sized


def ranked_probes(train_cells: DataFrame) -> DataFrame:
    """All probes with r and rank by |r|; ties go to the lower ordinal."""
    stats = probe_correlation(train_cells)
    return numbered(stats, [], [F.abs("r").desc(), PROBE], "rank")


def top_correlated(train_cells: DataFrame, k: int) -> DataFrame:
    """Best k probes by |r| with their rank."""
    best = probe_correlation(train_cells).orderBy(F.abs("r").desc(), PROBE).limit(k)
    return numbered(best, [], [F.abs("r").desc(), PROBE], "rank")


def two_stage(train_cells: DataFrame, n_var: int = 10_000, n_corr: int = 2_000) -> DataFrame:
    """Top probes by variance, then by |r| among those; both from a single aggregation.

    The variance is the NaN-skipping population variance; the result is in ordinal order.
    """
    stats = train_cells.groupBy(PROBE).agg(F.var_pop("beta").alias("variance"), pearson().alias("r"))
    wide = stats.orderBy(F.col("variance").desc_nulls_last(), PROBE).limit(n_var)
    return wide.orderBy(F.abs("r").desc(), PROBE).limit(n_corr).orderBy(PROBE)


def keep_probes(cells: DataFrame, chosen: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cells of the chosen probes; ``carry`` brings columns such as the rank along."""
    if not carry:
        return cells.join(sized(chosen.select(PROBE)), PROBE, "left_semi")
    return cells.join(sized(chosen.select(PROBE, *carry)), PROBE)


def top_rows(df: DataFrame, by: Column, n: int, *tie: str) -> DataFrame:
    return df.orderBy(by, *tie).limit(n)


def frequent_categories(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose category is among the n most frequent (ties by name)."""
    top = df.groupBy(col).count().orderBy(F.col("count").desc(), col).limit(n).select(col)
    return df.join(F.broadcast(top), col, "left_semi")  # at most n rows


def hashed_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same rows on every run."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}"))), id_col).limit(n)
