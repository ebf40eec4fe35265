"""Streaming use, an extension: tokens of arriving documents and a running worklist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import tokens


def doc_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def token_stream(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenization has no state, so the batch operator works on a stream as it is."""
    return tokens(docs, text, key)


def token_counts(stream: DataFrame) -> DataFrame:
    """Running counts of surface forms, for complete or update mode."""
    return stream.groupBy("token").agg(F.count("*").alias("count"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("count"))
