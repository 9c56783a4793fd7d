"""Descriptive statistics, correlations and trend lines."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.moments import correlation, kurtosis_sample, skewness_sample
from paceframe.operators.quantiles import ACCURACY, aggregate_with_quantiles, quantile_column
from paceframe.schemas import METRICS


def _basic(m: str) -> dict[str, Column]:
    return {
        "count": F.count(m),
        "mean": F.avg(m),
        "std": F.stddev_samp(m),
        "min": F.min(m).cast("double"),
        "max": F.max(m).cast("double"),
    }


def _per_metric(wide: DataFrame, metrics: Sequence[str], stats: dict[str, dict[str, Column]]) -> DataFrame:
    """One row with all figures to one row per metric."""
    rows = [
        F.struct(F.lit(m).alias("metric"), *[c.alias(name) for name, c in stats[m].items()]) for m in metrics
    ]
    return wide.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def describe_basic(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum per metric, in one pass."""
    wide = df.agg(*[c.alias(f"{m}__{k}") for m in metrics for k, c in _basic(m).items()])
    return _per_metric(
        wide, metrics, {m: {k: F.col(f"{m}__{k}") for k in _basic(m)} for m in metrics}
    )


def describe_quartiles(
    df: DataFrame, metrics: Sequence[str] = METRICS, accuracy: int = ACCURACY
) -> DataFrame:
    """The basic figures with quartiles and variance."""
    figures = {m: {**_basic(m), "variance": F.var_samp(m)} for m in metrics}
    return _with_quartiles(df, metrics, figures, accuracy)


def detailed_statistics(
    df: DataFrame,
    metrics: Sequence[str] = METRICS,
    digits: int | None = 2,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Location, spread, quartiles and shape per metric, rounded half to even."""
    figures = {
        m: {
            **{k: c for k, c in _basic(m).items() if k != "count"},
            "skewness": skewness_sample(m),
            "kurtosis": kurtosis_sample(m),
        }
        for m in metrics
    }
    out = _with_quartiles(df, metrics, figures, accuracy).withColumn("iqr", F.col("q3") - F.col("q1"))
    if digits is None:
        return out
    return out.select("metric", *[F.bround(c, digits).alias(c) for c in out.columns if c != "metric"])


def _with_quartiles(
    df: DataFrame, metrics: Sequence[str], figures: dict[str, dict[str, Column]], accuracy: int
) -> DataFrame:
    aggs = [c.alias(f"{m}__{k}") for m in metrics for k, c in figures[m].items()]
    wide = aggregate_with_quantiles(df, metrics, (0.25, 0.5, 0.75), (), aggs, accuracy)
    named = {
        m: {
            **{k: F.col(f"{m}__{k}") for k in figures[m]},
            **{q: F.col(quantile_column(m))[i] for i, q in enumerate(("q1", "median", "q3"))},
        }
        for m in metrics
    }
    return _per_metric(wide, metrics, named)


def kpi_statistics(df: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """Records, users, and mean / standard deviation / median of the headline metrics."""
    aggs = [
        F.count("*").alias("num_records"),
        F.count_distinct("user_id").alias("num_users"),
        F.avg("steps").alias("avg_steps"),
        F.stddev_samp("steps").alias("std_steps"),
        F.avg("calories_burned").alias("avg_calories"),
        F.stddev_samp("calories_burned").alias("std_calories"),
        F.avg("heart_rate_avg").alias("avg_hr"),
        F.stddev_samp("heart_rate_avg").alias("std_hr"),
        F.avg("sleep_hours").alias("avg_sleep"),
    ]
    metrics = ("steps", "calories_burned")
    wide = aggregate_with_quantiles(df, metrics, (0.5,), (), aggs, accuracy)
    return wide.withColumns(
        {
            "median_steps": F.col(quantile_column("steps"))[0],
            "median_calories": F.col(quantile_column("calories_burned"))[0],
        }
    ).drop(*[quantile_column(m) for m in metrics])


def activity_stats(
    df: DataFrame, digits: int | None = 2, accuracy: int = ACCURACY
) -> DataFrame:
    """Mean, median and standard deviation per activity, and mean sleep."""
    short = {"steps": "steps", "calories_burned": "calories", "heart_rate_avg": "hr"}
    aggs = [F.avg("sleep_hours").alias("mean_sleep")]
    for metric, name in short.items():
        aggs += [F.avg(metric).alias(f"mean_{name}"), F.stddev_samp(metric).alias(f"std_{name}")]
    wide = aggregate_with_quantiles(df, tuple(short), (0.5,), ("activity_type",), aggs, accuracy)
    out = wide.withColumns(
        {f"median_{name}": F.col(quantile_column(metric))[0] for metric, name in short.items()}
    ).drop(*[quantile_column(m) for m in short])
    if digits is None:
        return out
    return out.select(
        "activity_type", *[F.bround(c, digits).alias(c) for c in out.columns if c != "activity_type"]
    )


def correlation_matrix(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Pearson correlation of every pair of metrics as (metric_a, metric_b, corr) rows.

    Rows where one of the two values is missing are left out pair by pair. A pair is computed
    once and reported in both orders.
    """
    pairs = list(combinations(metrics, 2))
    wide = df.agg(
        *[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs],
        *[F.when(F.stddev_samp(m) > 0, 1.0).alias(f"{m}__{m}") for m in metrics],
    )
    cells = [(a, b, f"{a}__{b}") for a, b in pairs]
    cells += [(b, a, f"{a}__{b}") for a, b in pairs]
    cells += [(m, m, f"{m}__{m}") for m in metrics]
    rows = [
        F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(c).alias("corr"))
        for a, b, c in cells
    ]
    return wide.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def correlation_pairs(df: DataFrame) -> DataFrame:
    return df.agg(
        correlation("steps", "calories_burned").alias("steps_calories"),
        correlation("heart_rate_avg", "calories_burned").alias("hr_calories"),
    )


def trend_lines(df: DataFrame, x: str = "steps", y: str = "calories_burned", by: str = "activity_type") -> DataFrame:
    """Least-squares line of ``y`` on ``x`` per group."""
    return df.groupBy(by).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("num_points"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )
