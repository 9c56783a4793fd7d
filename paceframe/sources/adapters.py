"""Views of the TPC-H-like tables and the event table as activity telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_line_telemetry(lineitem: DataFrame) -> DataFrame:
    """Order lines as telemetry with all four metrics; the supplier plays the user."""
    return lineitem.select(
        F.col("l_suppkey").alias("user_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("bigint").alias("steps"),
        F.col("l_extendedprice").alias("calories_burned"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("heart_rate_avg"),
        F.round(F.col("l_tax") * 100).alias("sleep_hours"),
        F.concat("l_returnflag", "l_linestatus").alias("activity_type"),
    )


def as_event_telemetry(events: DataFrame) -> DataFrame:
    """Events as telemetry with an event time; heart rate and sleep are not recorded."""
    return events.select(
        "event_id",
        "user_id",
        F.to_date("ts").alias("date"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("steps"),
        F.col("value").alias("calories_burned"),
        F.lit(None).cast("bigint").alias("heart_rate_avg"),
        F.lit(None).cast("double").alias("sleep_hours"),
        F.col("event_type").alias("activity_type"),
    )


def line_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_line_telemetry(table(spark, sf_dir, "lineitem"))


def event_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_event_telemetry(table(spark, sf_dir, "events"))
