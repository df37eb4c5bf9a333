"""Responses as a stream. A Spark built-in beyond what batch users need: counts of outcomes in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def outcome_counts(responses: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """`responses` (ts timestamp, status): counts for each window and status; rows later than `late` fall away."""
    return responses.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "status", "n")
