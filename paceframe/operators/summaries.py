"""Grouped and overall summaries. Every report is one aggregation over one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceframe.functions.columns import guarded_ratio, month_period, percent, sleep_quality
from paceframe.functions.moments import correlation
from paceframe.schemas import HIGH_PERFORMER_STEPS, WEEKDAYS
from paceframe.sources.readers import rows

MEANS = {
    "avg_steps": "steps",
    "avg_calories": "calories_burned",
    "avg_hr": "heart_rate_avg",
    "avg_sleep": "sleep_hours",
}


def means(*names: str) -> list[Column]:
    return [F.avg(MEANS[n]).alias(n) for n in (names or MEANS)]


def preview(df: DataFrame, n: int = 5) -> None:
    """Schema and first rows on the console."""
    df.printSchema()
    df.show(n, truncate=False)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("num_records"))


def kpi_overview(df: DataFrame) -> DataFrame:
    """Records, users, activities, mean steps and calories, days covered."""
    return df.agg(
        F.count("*").alias("num_records"),
        F.count_distinct("user_id").alias("num_users"),
        F.count_distinct("activity_type").alias("num_activities"),
        *means("avg_steps", "avg_calories"),
        F.datediff(F.max("date"), F.min("date")).cast("bigint").alias("span_days"),
    )


def dataset_overview(df: DataFrame, files: bool = True) -> DataFrame:
    """Records, users, first and last date and, for a file-backed frame, the number of files."""
    parts = [
        F.count("*").alias("num_records"),
        F.count_distinct("user_id").alias("num_users"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    ]
    if files:
        parts.insert(0, F.count_distinct("_file").alias("total_files"))
    return df.agg(*parts)


def with_file(df: DataFrame) -> DataFrame:
    """Adds the path of the file each row was read from."""
    return df.withColumn("_file", F.col("_metadata.file_path"))


def monthly_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(month_period("date").alias("month")).agg(
        F.count("user_id").alias("num_records"),
        F.count_distinct("user_id").alias("num_users"),
        *means(),
    )


def activity_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("activity_type").agg(
        F.count("user_id").alias("num_records"),
        F.count_distinct("user_id").alias("num_users"),
        *means("avg_steps"),
        F.min("steps").alias("min_steps"),
        F.max("steps").alias("max_steps"),
        *means("avg_calories", "avg_hr", "avg_sleep"),
    )


def activity_means(df: DataFrame) -> DataFrame:
    return df.groupBy("activity_type").agg(*means())


def activity_ranked(df: DataFrame) -> DataFrame:
    """Means per activity to whole numbers (half to even), most frequent activity first."""
    rounded = [F.bround(F.avg(MEANS[n])).alias(n) for n in ("avg_steps", "avg_calories", "avg_hr")]
    return (
        df.groupBy("activity_type")
        .agg(*rounded, F.count("user_id").alias("num_records"))
        .orderBy(F.desc("num_records"), "activity_type")
    )


def mean_by_activity(df: DataFrame, metric: str, ascending: bool) -> DataFrame:
    mean = F.col("mean")
    return (
        df.groupBy("activity_type")
        .agg(F.avg(metric).alias("mean"))
        .orderBy(mean.asc() if ascending else mean.desc(), "activity_type")
    )


def daily_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(*means("avg_steps", "avg_calories", "avg_hr"))


def weekday_calendar_stats(df: DataFrame) -> DataFrame:
    """Means and counts by weekday on a full Mon..Sun calendar; absent days hold nulls."""
    calendar = rows(
        df.sparkSession, list(enumerate(WEEKDAYS, start=1)), "day_no int, day_of_week string"
    )
    stats = df.groupBy("day_of_week").agg(
        *means("avg_steps", "avg_calories"), F.count("user_id").alias("num_records")
    )
    return calendar.join(stats, "day_of_week", "left").orderBy("day_no")


def most_active_weekday_sql(df: DataFrame, view: str = "telemetry_view") -> DataFrame:
    """Mean steps by weekday, asked in SQL of a global temporary view."""
    df.createOrReplaceGlobalTempView(view)
    return df.sparkSession.sql(
        f"""
        SELECT day_of_week, avg(steps) AS average_steps
        FROM global_temp.{view}
        GROUP BY day_of_week
        ORDER BY average_steps DESC, day_of_week
        """
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count("*").alias("num_records")).orderBy(F.desc("num_records"), column)
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent of all rows per value; missing values are left out."""
    counts = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("num_records"))
    )
    # The total is taken from the counts, whose exchange is computed once for both uses.
    total = counts.agg(F.sum("num_records").alias("n")).scalar()
    return counts.withColumn("share_pct", percent(F.col("num_records"), total))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The mode; among equal counts the first by name."""
    return value_counts(df.where(F.col(column).isNotNull()), column).limit(1)


def user_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(*means("avg_steps", "avg_calories", "avg_hr"))


def ratings(df: DataFrame) -> DataFrame:
    """How often each user did each activity."""
    return df.groupBy("user_id", "activity_type").agg(F.count("*").alias("rating"))


def top_activities_per_user(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent activities of each user, ranked on the aggregated counts."""
    order = Window.partitionBy("user_id").orderBy(F.desc("rating"), "activity_type")
    return ratings(df).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share_above(metric: str = "steps", threshold: float = HIGH_PERFORMER_STEPS) -> Column:
    """Percent of all rows above the threshold; null values do not count as above."""
    return F.avg(F.when(F.col(metric) > threshold, 1.0).otherwise(0.0)) * 100.0


def high_performer_share(
    df: DataFrame, metric: str = "steps", threshold: float = HIGH_PERFORMER_STEPS
) -> DataFrame:
    return df.agg(share_above(metric, threshold).alias("share_pct"))


def efficiency_by_totals(df: DataFrame) -> DataFrame:
    """The activity with most calories per step, by totals."""
    per_activity = df.groupBy("activity_type").agg(
        guarded_ratio(F.sum("calories_burned"), F.sum("steps")).alias("cal_per_step")
    )
    return per_activity.orderBy(F.desc("cal_per_step"), "activity_type").limit(1)


def efficiency_by_means(df: DataFrame, top: int = 5) -> DataFrame:
    """Activities by mean calories per mean step, three decimals (half to even)."""
    ratio = guarded_ratio(F.avg("calories_burned"), F.avg("steps"))
    return (
        df.groupBy("activity_type")
        .agg(F.bround(ratio, 3).alias("calories_per_step"))
        .orderBy(F.desc("calories_per_step"), "activity_type")
        .limit(top)
    )


def activity_breakdown_sql(df: DataFrame, view: str) -> DataFrame:
    """Counts and rounded means per activity of a live table, asked in SQL."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(
        f"""
        SELECT activity_type, count(*) AS num_records,
               round(avg(steps), 2) AS avg_steps, round(avg(calories_burned), 2) AS avg_calories
        FROM {view}
        GROUP BY activity_type
        ORDER BY num_records DESC, activity_type
        """
    )


def latest(df: DataFrame, n: int = 30, time: str = "timestamp", tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc(time), *tie_break).limit(n)


def summary_document(df: DataFrame, files: bool = True) -> DataFrame:
    """One nested row: overview, list of months, list of activities.

    The lists are collected from aggregated rows, as many as there are months and activities.
    """
    overview = dataset_overview(df, files)
    counts = [c for c in ("total_files", "num_records", "num_users") if c in overview.columns]

    def as_list(report: DataFrame) -> Column:
        return report.agg(F.array_sort(F.collect_list(F.struct(*report.columns))).alias("list")).scalar()

    return overview.select(
        F.struct(
            *counts,
            F.array(F.col("first_date").cast("string"), F.col("last_date").cast("string")).alias("time_range"),
        ).alias("dataset_overview"),
        as_list(monthly_summary(df)).alias("monthly_summary"),
        as_list(activity_summary(df)).alias("activity_summary"),
    )


def key_findings(df: DataFrame, threshold: float = HIGH_PERFORMER_STEPS) -> DataFrame:
    """The headline findings in one row: one overall aggregation and one per activity."""
    per_activity = df.where(F.col("activity_type").isNotNull()).groupBy("activity_type").agg(
        F.count("*").alias("n"),
        guarded_ratio(F.sum("calories_burned"), F.sum("steps")).alias("cal_per_step"),
    )
    activities = per_activity.agg(
        F.struct(
            F.count("*").alias("number"),
            F.min_by("activity_type", F.struct(-F.col("n"), "activity_type")).alias("popular"),
            F.min_by("activity_type", F.struct(-F.col("cal_per_step"), "activity_type")).alias("efficient"),
        ).alias("a")
    )
    overall = df.agg(
        F.avg("steps").alias("avg_steps"),
        share_above("steps", threshold).alias("high_performer_pct"),
        F.avg("heart_rate_avg").alias("avg_hr"),
        F.min("heart_rate_avg").alias("min_hr"),
        F.max("heart_rate_avg").alias("max_hr"),
        F.avg("sleep_hours").alias("avg_sleep"),
        correlation("steps", "calories_burned").alias("steps_calories_corr"),
        correlation("heart_rate_avg", "calories_burned").alias("hr_calories_corr"),
    )
    return (
        overall.withColumn("_a", activities.scalar())
        .withColumns(
            {
                "sleep_quality": sleep_quality("avg_sleep"),
                "num_activities": F.col("_a.number"),
                "most_popular_activity": F.col("_a.popular"),
                "most_efficient_activity": F.col("_a.efficient"),
            }
        )
        .drop("_a")
    )
