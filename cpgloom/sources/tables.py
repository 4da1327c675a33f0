"""Small files around the matrix: annotations, probe lists, results; and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION_SCHEMA = "sample_name STRING, female STRING, ethnicity STRING, age DOUBLE, sample_id STRING"


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation CSV without the rows that lack an age or an id.

    The header names the columns; ``Sample_description`` (or ``sample_id``) is the key.
    """
    raw = spark.read.option("header", True).csv(path)
    renames = {"Sample_description": "sample_id", "Sample_name": "sample_name", "Sample_Name": "sample_name"}
    for old, new in renames.items():
        if old in raw.columns and new not in raw.columns:
            raw = raw.withColumnRenamed(old, new)
    if not {"age", "sample_id"} <= set(raw.columns):
        raise ValueError(f"annotations need an age and an id column, found {raw.columns}")
    return raw.withColumns({"age": F.col("age").try_cast("double"), "sample_id": F.col("sample_id").cast("string")}).dropna(
        subset=["age", "sample_id"]
    )


def find_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths, sizes and modification times of matching files; an error when there is none."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    if files.isEmpty():
        raise FileNotFoundError(f"no file matching {pattern} in {folder}")
    return files


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the most recently modified match (ties by path)."""
    best = F.max_by("path", F.struct("modificationTime", "path"))
    return find_files(spark, folder, pattern).agg(best.alias("path")).first()["path"]


def read_optional(spark: SparkSession, path: str, fmt: str = "csv", schema: str | None = None) -> DataFrame | None:
    """The table at ``path``, or None when nothing is there."""
    try:
        reader = spark.read.format(fmt).option("header", True)
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_clock_probes(spark: SparkSession, path: str | None) -> DataFrame:
    """Distinct probe ids of a headerless text list; empty for no path or a missing file."""
    empty = spark.createDataFrame([], "probe_id STRING")
    if path is None:
        return empty
    lines = read_optional(spark, path, "text")
    if lines is None:
        return empty
    return lines.select(F.trim("value").alias("probe_id")).where("probe_id <> ''").distinct()


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite a result table; CSV gets a header line."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def ground_truth(spark: SparkSession, preds: DataFrame, path: str | None = None) -> DataFrame:
    """One row per test sample with its true age; an existing file wins."""
    if path is not None:
        kept = read_optional(spark, path, "csv", "sample_id STRING, true_age DOUBLE")
        if kept is not None:
            return kept
    truth = (
        preds.where(F.col("split") == "test")
        .groupBy(F.col("sample_id").cast("string").alias("sample_id"))
        .agg(F.min_by("y_true", "model").alias("true_age"))
    )
    if path is not None:
        write_table(truth, path, "csv")
    return truth
