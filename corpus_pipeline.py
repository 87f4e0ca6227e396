"""Corpus pipeline: quality, near copies, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, folder of tables) and returns rows that are
written as Parquet and read again as the next stage's documents."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raincourier.llm import decontaminate, mixing, pu_classifier, secrets, token_groups
from raincourier.sources.scratch import written


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return pu_classifier.keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return token_groups.keep_one(docs, width=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the new text."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mixture: a row for each time a document is used."""
    return mixing.mix_sources(docs)[0]


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("secret scans", redact), ("mixing sources", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), "pipeline-" + name.replace(" ", "-"))
    return docs
