"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cpgloom.session import scratch_path

BROADCAST_BYTES = 64 * 1024 * 1024


def _field_bytes(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.size(col), F.lit(0)) * 8 + 24
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):  # nested values: as long as their text, and their headers
        return F.coalesce(F.octet_length(col.cast("string")), F.lit(0)) * 2 + 64
    return F.lit(16)


def sized(df: DataFrame, limit: int | None = None, label: str = "dim") -> DataFrame:
    """``df`` ready to be the smaller side of a join: stored, measured, broadcast if it fits.

    The dimension is computed once into the shared folder (under ``label``) and its in-memory size is summed in
    the same job.  Up to ``limit`` it is broadcast; beyond that the stored table is returned as it
    is, so Spark shuffles both sides and adaptive execution splits skewed keys.  The size changes
    the plan, never the result.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    per_row = sum((_field_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    df.observe(seen, F.coalesce(F.sum(per_row), F.lit(0).cast("long")).alias("bytes")).write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    return F.broadcast(stored) if seen.get["bytes"] <= limit else stored
