"""Batch and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import schemas


def _csv(reader, schema):
    return reader.option("sep", ",").option("header", False).schema(schema)


def read_flows(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Header-less flow records; a field that does not parse is null."""
    return _csv(spark.read, schema or schemas.STATS_FLOW.schema).csv(path)


def stream_flows(spark: SparkSession, path: str, schema=None, max_files: int | None = None) -> DataFrame:
    """A directory of flow files as a stream."""
    reader = _csv(spark.readStream, schema or schemas.STATS_FLOW.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(path)


def stream_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A directory of message files as a stream of ``value`` strings."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def payload_stream(df: DataFrame, column: str = "value") -> DataFrame:
    """Messages of any stream (broker, files, memory) as ``value`` strings."""
    return df.select(F.col(column).cast("string").alias("value"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(label, prediction) result files."""
    return _csv(spark.read, schemas.PREDICTION).csv(path)
