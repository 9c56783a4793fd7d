"""The feature transform of the batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.functions.columns import day_of_week, guarded_ratio


def add_features(df: DataFrame) -> DataFrame:
    """Weekday name and calories per step, beside all columns of the input."""
    return df.withColumns(
        {
            "day_of_week": day_of_week("date"),
            "calories_to_steps_ratio": guarded_ratio("calories_burned", "steps"),
        }
    )


def add_partition_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"year": F.year("date"), "month": F.month("date")})
