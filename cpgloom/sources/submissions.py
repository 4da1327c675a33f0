"""Uploads and the submission store of the leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.functions.scalars import short_hash, text_or
from cpgloom.operators.metrics import error_metrics, metrics_rounded
from cpgloom.operators.ordering import numbered
from cpgloom.operators.sizing import sized
from cpgloom.session import materialize

SUBMISSION_SCHEMA = (
    "id STRING, username STRING, model_category STRING, description STRING, "
    "metrics STRUCT<mae: DOUBLE, rmse: DOUBLE, r2: DOUBLE, correlation: DOUBLE, mad: DOUBLE>, "
    "n_samples BIGINT, date STRING"
)

# Accepted header names, in order of preference.
ID_HEADERS = ["sample_id", "Sample_Name"]
AGE_HEADERS = ["predicted_age", "age_pred", "prediction"]

_OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    plain = F.transform(F.split(line, ",", -1), lambda c: F.trim(c))
    quoted = F.transform(F.split(line, _OUTSIDE_QUOTES, -1), lambda c: F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', "")))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def _first_position(header: Column, names: list[str]) -> Column:
    """1-based place of the first accepted name, null when none is present."""
    return F.coalesce(*[F.nullif(F.array_position(header, n), F.lit(0)) for n in names])


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters cannot be pushed through and evaluated again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _decoded(uploads: DataFrame) -> DataFrame:
    """Uploads with their lines and the places of the id and age columns in the header."""
    body = F.element_at(F.split("contents", ",", 2), -1)
    out = uploads.withColumn("_body", body)
    text = F.regexp_replace(F.expr("try_to_binary(_body, 'base64')").cast("string"), "\r|\n+$", "")
    out = _once(out, "_lines", F.split(text, "\n")).drop("_body")
    out = _once(out, "_header", _fields(F.element_at("_lines", 1)))
    header = F.col("_header")
    return out.withColumns({"_id": _first_position(header, ID_HEADERS), "_age": _first_position(header, AGE_HEADERS)})


def parse_uploads(uploads: DataFrame, key: str = "upload_id") -> DataFrame:
    """Rows ``(key, sample_id, predicted_age)`` of the readable uploads."""
    ok = _decoded(uploads.select(key, "contents")).where("_id is not null and _age is not null")
    body = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))
    rows = ok.select(key, "_id", "_age", F.explode(body).alias("_line"))
    rows = rows.select(key, "_id", "_age", _fields(F.col("_line")).alias("_f"))
    return rows.select(
        key,
        F.try_element_at("_f", F.col("_id").cast("int")).alias("sample_id"),
        F.try_element_at("_f", F.col("_age").cast("int")).try_cast("double").alias("predicted_age"),
    )


def rejected_uploads(uploads: DataFrame, key: str = "upload_id") -> DataFrame:
    """Uploads that cannot be scored, with the reason."""
    reason = (
        F.when(F.col("_lines").isNull(), "unreadable")
        .when(F.col("_id").isNull() & F.col("_age").isNull(), "no id and no age column")
        .when(F.col("_id").isNull(), "no id column")
        .when(F.col("_age").isNull(), "no age column")
    )
    return _decoded(uploads.select(key, "contents")).withColumn("reason", reason).where("reason is not null").select(key, "reason")


def match_to_truth(parsed: DataFrame, truth: DataFrame) -> DataFrame:
    """Uploaded predictions of known samples, ids compared as text."""
    t = truth.select(F.col("sample_id").cast("string").alias("sample_id"), F.col("true_age").alias("y_true"))
    p = parsed.withColumn("sample_id", F.col("sample_id").cast("string")).withColumnRenamed("predicted_age", "y_pred")
    return p.join(sized(t), "sample_id")


def reconcile_uploads(parsed: DataFrame, truth: DataFrame, key: str = "upload_id") -> DataFrame:
    """Matched, missing and extra id counts per upload."""
    ids = parsed.select(key, F.col("sample_id").cast("string").alias("sample_id")).distinct()
    t = truth.select(F.col("sample_id").cast("string").alias("sample_id")).distinct().withColumn("_hit", F.lit(1))
    expected = t.agg(F.count("*").alias("n")).select("n").scalar()
    counts = ids.join(sized(t), "sample_id", "left").groupBy(key).agg(F.count("_hit").alias("matched"), F.count("*").alias("_all"))
    return counts.select(key, "matched", (expected - F.col("matched")).alias("missing"), (F.col("_all") - F.col("matched")).alias("extra"))


def score_uploads(uploads: DataFrame, truth: DataFrame) -> DataFrame:
    """Submission records for all uploads that share at least one sample with the truth."""
    # Parsing is the costly part and the median needs two passes: keep the matched rows.
    matched = materialize(match_to_truth(parse_uploads(uploads), truth), "matched")
    scored = metrics_rounded(error_metrics(matched, ["upload_id"]))
    info = uploads.select("upload_id", "username", "model_category", "description", "date")
    return scored.join(info, "upload_id").select(
        short_hash("username", "date").alias("id"),
        "username",
        "model_category",
        text_or("description", "Non fournie").alias("description"),  # a fixed value
        F.struct("mae", "rmse", "r2", "correlation", "mad").alias("metrics"),
        F.col("n").alias("n_samples"),
        "date",
    )


def append_submissions(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSION_SCHEMA).json(path)


def leaderboard(records: DataFrame, mae: str = "mae", tie: str = "id") -> DataFrame:
    """All submissions by MAE with rank and medal; ranked without a global window."""
    ranked = numbered(records, [], [mae, tie], "rank")
    medal = F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze")
    return ranked.withColumn("medal", medal.otherwise(F.concat(F.lit("#"), F.col("rank").cast("string"))))


def leaderboard_kpis(records: DataFrame, mae: str = "mae") -> DataFrame:
    return records.agg(
        F.min(mae).alias("best_mae"), F.count("*").alias("total"), F.countDistinct("username").alias("participants")
    )
