"""User segments: profiles of clusters and activity tiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.functions.columns import tier
from paceframe.operators.summaries import value_shares
from paceframe.schemas import FIVE_TIERS


def cluster_profile(segments: DataFrame) -> DataFrame:
    """Means and users per cluster, least active first."""
    return (
        segments.groupBy("prediction")
        .agg(
            F.avg("avg_steps").alias("avg_steps"),
            F.avg("avg_calories").alias("avg_calories"),
            F.avg("avg_hr").alias("avg_hr"),
            F.count("*").alias("num_users"),
        )
        .orderBy("avg_steps", "prediction")
    )


def cluster_tiers(
    segments: DataFrame, ladder: Iterable[tuple[float | None, str]] = FIVE_TIERS
) -> DataFrame:
    """The profile with the tier name of each cluster's mean steps."""
    return cluster_profile(segments).withColumn("tier", tier("avg_steps", ladder))


def cluster_sizes(segments: DataFrame) -> DataFrame:
    return segments.groupBy("prediction").agg(F.count("*").alias("num_users"))


def cluster_shares(segments: DataFrame) -> DataFrame:
    return value_shares(segments, "prediction").withColumnRenamed("num_records", "num_users")
