"""Wide CSV matrices: probes as lines, samples as columns.

A wide file is parsed once into the long, Parquet-backed form; row order carries meaning (names
are matched by position), so lines get explicit ordinals first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cpgloom.operators.sizing import sized
from cpgloom.session import materialize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, value)`` for every text line, 0-based over the files in name order.

    Inside an input split the rows keep file order, so a slot number is enough there; the
    starts of the splits come from one count per split.  No shuffle of the text itself.
    """
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    splits = lines.groupBy("_file", "_start").agg(F.min("_slot").alias("_first"), F.count("*").alias("_n"))
    order = Window.partitionBy(F.lit(0)).orderBy("_file", "_start")  # one row per input split
    splits = splits.select("_file", "_start", (F.sum("_n").over(order) - F.col("_n") - F.col("_first")).alias("_shift"))
    return lines.join(sized(splits), ["_file", "_start"]).select((F.col("_slot") + F.col("_shift")).alias("ordinal"), "value")


def _clean(cell):
    return F.trim(F.regexp_replace(cell, '^\\s*"|"\\s*$', ""))


def _cells(line):
    return F.transform(F.split(line, ",", -1), _clean)


def read_wide(
    spark: SparkSession, path: str, samples: DataFrame | None = None, has_index: bool = False
) -> DataFrame:
    """Long cells ``(probe_ord, sample_id, beta)`` of a wide CSV; optional pruning to known samples.

    Empty, NA and NaN cells become null; a line shorter than the header has no cells for the rest.  Only the
    wanted places of a line are cleaned and become rows; their list, a part of one line, is a scalar subquery.
    """
    lines = numbered_lines(spark, path)
    header = header_columns(spark, path, has_index)
    if samples is not None:
        header = header.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    wanted = header.agg(F.sort_array(F.collect_list(F.struct("col", "sample_id")))).scalar()
    number = _clean(F.get("cells", F.col("at.col"))).try_cast("double")
    # The generator is compiled with what follows it, so its rows refer to the split line and don't copy it.
    return (
        lines.where("ordinal > 0")
        .select((F.col("ordinal") - 1).alias("probe_ord"), F.split("value", ",", -1).alias("cells"), wanted.alias("wanted"))
        .select("probe_ord", "cells", F.explode("wanted").alias("at"))
        .where(F.col("at.col") < F.size("cells"))
        .select("probe_ord", F.col("at.sample_id").alias("sample_id"), F.when(~F.isnan(number), number).alias("beta"))
    )


def header_columns(spark: SparkSession, path: str, has_index: bool = False) -> DataFrame:
    """``(col, sample_id)`` from the first line of the first file; no other line is read."""
    first = min(spark.read.text(path).inputFiles())
    line = spark.read.text(first).head(1)[0]["value"]
    names = spark.createDataFrame([(line,)], "value STRING").select(F.posexplode(_cells(F.col("value"))).alias("col", "sample_id"))
    return names.where(F.col("col") >= (1 if has_index else 0))


def ingest(spark: SparkSession, path: str, out: str, samples: DataFrame | None = None, has_index: bool = False) -> DataFrame:
    """Parse a wide file once and store it clustered by probe."""
    cells = read_wide(spark, path, samples, has_index)
    cells.repartitionByRange("probe_ord", "sample_id").sortWithinPartitions("probe_ord", "sample_id").write.mode(
        "overwrite"
    ).parquet(out)
    return spark.read.schema(cells.schema).parquet(out)


def export_wide(cells: DataFrame, path: str, order: str = "sample_id", value: str = "beta") -> None:
    """Write the long matrix back as a wide CSV; part files in name order form the file.

    One line holds all samples of a probe: that is the format, not a choice made here.  Values go
    to the place of their sample in the header; absent cells are empty, repeated ones an error.
    """
    names = cells.select(F.col(order).alias("o"), "sample_id").distinct()
    names = materialize(names.agg(F.sort_array(F.collect_list(F.struct("o", "sample_id"))).alias("e")), "header")
    places = names.select(F.size("e").alias("_n"), F.posexplode("e").alias("_at", "s")).select("_n", "_at", F.col("s.sample_id").alias("sample_id"))
    entry = F.struct(F.col("_at").alias("at"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))
    body = cells.join(sized(places), "sample_id").groupBy("probe_ord").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.first("_n").alias("n"))
    # As many commas before a value as there are places since the one before.
    gaps = F.transform("e", lambda x, i: x["at"] - F.when(i > 0, F.get("e", i - 1)["at"]).otherwise(0))
    body = body.withColumn("gaps", gaps)
    body = body.withColumn("twice", F.exists(F.slice("gaps", 2, F.greatest(F.size("gaps") - 1, F.lit(0))), lambda g: g == 0))
    filled = F.zip_with("gaps", "e", lambda g, x: F.concat(F.repeat(F.lit(","), g), x["v"]))
    rest = F.repeat(F.lit(","), F.col("n") - 1 - F.element_at("e", -1)["at"])
    line = F.when(F.col("twice"), F.raise_error(F.lit("a probe has two values of one sample"))).otherwise(F.concat(F.array_join(filled, ""), rest))
    body = body.select("probe_ord", line.alias("value"))
    head = names.select(
        F.lit(-1).cast("long").alias("probe_ord"), F.concat_ws(",", F.transform("e", lambda x: x["sample_id"])).alias("value")
    )
    head.unionByName(body).repartitionByRange("probe_ord").sortWithinPartitions("probe_ord").select("value").write.text(path)


def read_probe_names(spark: SparkSession, path: str) -> DataFrame:
    """``(probe_ord, probe_id)`` from a one-column CSV with a header line."""
    return numbered_lines(spark, path).where("ordinal > 0").select(
        (F.col("ordinal") - 1).alias("probe_ord"), F.trim(F.regexp_replace("value", '"', "")).alias("probe_id")
    )
