"""From raw documents to training text: five stages, each the whole work of one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpgloom.llm import decontaminate, line_dedup, ngram_join, quality, sentencepiece_fst
from cpgloom.session import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs, and with them the documents that have no other line."""
    out = line_dedup.drop_repeated_lines(docs)
    kept = out.where("n_removed = 0 or n_removed < n_lines")
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return ngram_join.drop_near_copies(docs, width=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the SentencePiece ids of the text and their number."""
    return sentencepiece_fst.encode(docs).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", single_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", clean_of_benchmark),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


# The classifier is a fitted model, which SQL can't express.
ORACLE_SQL = None
