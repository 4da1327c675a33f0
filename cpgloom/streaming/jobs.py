"""Incremental versions of two reports as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.operators.ordering import numbered
from cpgloom.session import materialize
from cpgloom.sources.submissions import SUBMISSION_SCHEMA, score_uploads

CELL_SCHEMA = "probe_ord BIGINT, sample_id STRING, beta DOUBLE"
UPLOAD_SCHEMA = "upload_id STRING, username STRING, model_category STRING, description STRING, date STRING, contents STRING"


def _overwrite(path: str):
    """Sink for complete-mode results: each epoch replaces the table, so a replay is harmless."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return put


def run_sample_moments(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Per-sample count, mean and variance over matrix chunks as they arrive.

    The state is one small buffer per sample, whatever the number of probes seen.
    """
    reader = spark.readStream.schema(CELL_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    stats = (
        reader.parquet(source)
        .groupBy("sample_id")
        .agg(F.count("beta").alias("n"), F.avg("beta").alias("mean"), F.var_pop("beta").alias("variance"))
    )
    q = (
        stats.writeStream.outputMode("complete")
        .foreachBatch(_overwrite(out))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def run_best_per_user(
    spark: SparkSession, source: str, out: str, checkpoint: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Best score, number of submissions and rank per user over arriving submission files.

    Repeated ids count once, however late they arrive: the state holds every id seen, spread
    over the partitions by hash.  Every epoch writes the ranked users to ``out`` and the key
    figures (best score, submissions, participants) to ``<out>-kpis``.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        # Ranking and key figures read it several times; the stateful part should run once.
        users = materialize(batch, "best-users")
        rank_users(users).write.mode("overwrite").parquet(out)
        kpis = users.agg(F.min("best_mae").alias("best_mae"), F.sum("n").alias("total"), F.count("*").alias("participants"))
        kpis.write.mode("overwrite").parquet(f"{out}-kpis")

    reader = spark.readStream.schema(SUBMISSION_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    subs = reader.json(source).dropDuplicates(["id"])
    best = subs.groupBy("username").agg(F.min("metrics.mae").alias("best_mae"), F.count("*").alias("n"))
    q = (
        best.writeStream.outputMode("complete")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def rank_users(best: DataFrame) -> DataFrame:
    return numbered(best, [], ["best_mae", "username"], "rank")


def run_scoring(spark: SparkSession, source: str, truth: DataFrame, store: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Score arriving upload files against the truth into an append-only store.

    Every epoch owns one folder of the store and overwrites it, so a restarted epoch does not
    count twice.  The truth is stored once for the whole run, a batch once per epoch.
    """
    truth = materialize(truth, "truth")

    def put(batch: DataFrame, epoch: int) -> None:
        score_uploads(materialize(batch, "uploads"), truth).write.mode("overwrite").json(f"{store}/epoch={epoch}")

    reader = spark.readStream.schema(UPLOAD_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    q = (
        reader.json(source)
        .writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(SUBMISSION_SCHEMA).json(f"{store}/epoch=*")
