"""From selected long cells to one feature array or vector per sample."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cpgloom.operators.sizing import sized


def with_samples(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Cells of the given samples with the samples' columns attached.

    The sample table is measured before it is broadcast.  Left alone, the optimizer may pick the
    cells: it does not see how many rows an exploded column becomes.
    """
    return cells.join(sized(samples), "sample_id")


def feature_arrays(cells: DataFrame, value: str = "beta", order: str = "rank") -> DataFrame:
    """``(sample_id, features ARRAY)`` in rank order; expects one row per sample and selected probe.

    The array is as long as the selection, a few thousand at most, so a group never grows with
    the data.
    """
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return cells.groupBy("sample_id").agg(F.transform(pairs, lambda p: p["v"]).alias("features"))


def with_vectors(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn(col, array_to_vector(F.col(col)))
