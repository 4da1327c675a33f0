"""Deterministic splits and folds.

Order comes from ``md5(id | seed)``: the same ids and seed give the same split on any cluster
and in any engine, and adding columns or partitions changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.ordering import numbered


def shuffle_key(id_col: str, seed: int | Column = 42) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit("|"), seed.cast("string")))


def train_test_split(
    ids: DataFrame,
    test_share: float = 0.2,
    seed: int = 42,
    id_col: str = "sample_id",
    strata: Sequence[str] = (),
    out: str = "split",
) -> DataFrame:
    """Mark ceil(share * n) rows (of each stratum) as test, the others as train."""
    keyed = ids.withColumn("_key", shuffle_key(id_col, seed))
    rows = numbered(keyed, strata, ["_key", id_col], "_rn", "_n")
    test = F.col("_rn") <= F.ceil(F.col("_n") * F.lit(test_share))
    return rows.withColumn(out, F.when(test, "test").otherwise("train")).select(*ids.columns, out)


def kfold(
    ids: DataFrame, k: int = 5, seed: int = 42, id_col: str = "sample_id", group: Sequence[str] = (), out: str = "fold"
) -> DataFrame:
    """Shuffled fold number 0 .. k-1; fold sizes differ by at most one."""
    rows = numbered(ids.withColumn("_key", shuffle_key(id_col, seed)), group, ["_key", id_col], "_rn")
    return rows.withColumn(out, (F.col("_rn") - 1) % k).select(*ids.columns, out)


def repeated_kfold(ids: DataFrame, k: int = 5, repeats: int = 3, seed: int = 42, id_col: str = "sample_id") -> DataFrame:
    """One fold assignment per repeat, each shuffled by its own key."""
    each = ids.withColumn("repeat", F.explode(F.array(*[F.lit(i).cast("long") for i in range(repeats)])))
    keyed = each.withColumn("_key", shuffle_key(id_col, F.col("repeat") + seed))
    rows = numbered(keyed, ["repeat"], ["_key", id_col], "_rn")
    return rows.withColumn("fold", (F.col("_rn") - 1) % k).select(*ids.columns, "repeat", "fold")


def validation_split(
    train: DataFrame, seed: int = 7, id_col: str = "sample_id", out: str = "is_validation", group: Sequence[str] = ()
) -> DataFrame:
    """Carve max(20, n div 5) validation rows out of the training rows (of each group)."""
    rows = numbered(train.withColumn("_key", shuffle_key(id_col, seed)), group, ["_key", id_col], "_rn", "_n")
    held = F.greatest(F.lit(20), F.floor(F.col("_n") / 5))
    return rows.withColumn(out, F.col("_rn") <= held).select(*train.columns, out)
