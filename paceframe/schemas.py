"""Table schemas and the fixed values of the telemetry domain."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# One row per user and day, as delivered: the date is still text.
RAW_DAILY = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("steps", T.LongType()),
        T.StructField("calories_burned", T.DoubleType()),
        T.StructField("heart_rate_avg", T.LongType()),
        T.StructField("sleep_hours", T.DoubleType()),
        T.StructField("activity_type", T.StringType()),
    ]
)

# Live events: the event time is still text.
RAW_STREAM = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("steps", T.LongType()),
        T.StructField("calories_burned", T.DoubleType()),
        T.StructField("heart_rate_avg", T.LongType()),
        T.StructField("sleep_hours", T.DoubleType()),
        T.StructField("activity_type", T.StringType()),
    ]
)

# The table the batch job writes, partitioned by its last two columns.
PROCESSED = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("steps", T.LongType()),
        T.StructField("calories_burned", T.DoubleType()),
        T.StructField("heart_rate_avg", T.LongType()),
        T.StructField("sleep_hours", T.DoubleType()),
        T.StructField("activity_type", T.StringType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("calories_to_steps_ratio", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
    ]
)

METRICS = ("steps", "calories_burned", "heart_rate_avg", "sleep_hours")

# Weekday names in calendar order.
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")



class ValidRange(NamedTuple):
    metric: str
    low: float
    high: float
    rule: str


# The accepted range of each metric, both ends included.
VALID_RANGES = (
    ValidRange("steps", 0, 50000, "Steps should be between 0-50,000"),
    ValidRange("calories_burned", 0, 5000, "Calories should be between 0-5,000"),
    ValidRange("heart_rate_avg", 40, 220, "Heart rate should be between 40-220 bpm"),
    ValidRange("sleep_hours", 0, 24, "Sleep should be between 0-24 hours"),
)

# Upper bounds (exclusive) and names of the activity tiers, then the top tier.
FIVE_TIERS = (
    (5000, "Sedentary"),
    (8000, "Lightly Active"),
    (10000, "Active"),
    (15000, "Very Active"),
    (None, "Athlete"),
)
FOUR_TIERS = (
    (5000, "Sedentary"),
    (8000, "Lightly Active"),
    (10000, "Active"),
    (None, "High Performer"),
)

# Fixed value: mean sleep from which sleep quality counts as good.
GOOD_SLEEP_HOURS = 7.0

# Fixed value: daily steps above which a row counts as a high performer.
HIGH_PERFORMER_STEPS = 10000


def check_schema(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Fail early when a column of ``expected`` is absent or has another type."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        + (actual[f.name].simpleString() if f.name in actual else "nothing")
        for f in expected.fields
        if actual.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df
