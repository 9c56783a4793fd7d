"""File streams of telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paceframe.functions.columns import nan_to_null, parse_timestamp
from paceframe.schemas import RAW_STREAM


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = RAW_STREAM,
    files_per_batch: int | None = 1,
    glob: str | None = "*.parquet",
) -> DataFrame:
    """Parquet files dropped into ``path``, with a declared schema; NaN becomes null."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return nan_to_null(reader.parquet(path))


def with_event_time(stream: DataFrame, strict: bool = True) -> DataFrame:
    """Text event time to a timestamp."""
    return stream.withColumn("timestamp", parse_timestamp("timestamp", strict))
