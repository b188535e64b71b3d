"""Readers: documents, uploads, evaluation sets, stored policy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlake.functions.text import char_hygiene

ROUTING_SET = "prompt string, messages array<struct<role: string, content: string>>, expectedRoute string, expected string, category string"


def text_documents(spark: SparkSession, path: str, hygiene: bool = False) -> DataFrame:
    """(document_id, page, text) of text and Markdown files, each one page."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("document_id"), F.lit(1).alias("page"), F.col("value").alias("text"))
    return files.withColumn("text", char_hygiene(F.col("text"))) if hygiene else files


def uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def routing_set(spark: SparkSession, path: str) -> DataFrame:
    """(prompt, expected, category): the last user message stands for a conversation."""
    told = spark.read.schema(ROUTING_SET).json(path, multiLine=True)
    spoken = F.filter("messages", lambda m: m["role"] == "user")
    last = F.element_at(F.transform(spoken, lambda m: m["content"]), -1)
    return told.select(F.coalesce("prompt", F.when(F.size(spoken) > 0, last)).alias("prompt"), F.coalesce("expectedRoute", "expected").alias("expected"), "category")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it was read in fewer parts, as a small table of one row group is.

    Tables of many parts, which is every large one, stay as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
