"""Windowed counts on event time; the same code serves streams and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(
    df: DataFrame, width: str = "30 seconds", lateness: str | None = "1 minute", time: str = "timestamp"
) -> DataFrame:
    """Rows per tumbling window and activity.

    On a stream, rows later than ``lateness`` behind the newest event are dropped once their
    window is closed, and closed windows leave the state.
    """
    marked = df.withWatermark(time, lateness) if lateness and df.isStreaming else df
    return marked.groupBy(F.window(time, width), "activity_type").agg(F.count("*").alias("num_records"))


def window_start(time: Column, seconds: int) -> Column:
    """Start of the tumbling window of ``seconds`` that holds ``time``."""
    micros = F.unix_micros(time)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def nested_counts(df: DataFrame, widths: Sequence[int], time: str = "timestamp") -> DataFrame:
    """Rows per activity and tumbling window, for windows of several ``widths`` (seconds) at once.

    No row is too late and no window is closed, so a stream keeps all windows in its state. Rows
    without a time are counted in a window without bounds.
    """
    each = [
        F.struct(
            window_start(F.col(time), w).alias("window_start"),
            (window_start(F.col(time), w) + F.make_dt_interval(secs=F.lit(w))).alias("window_end"),
            F.lit(w).alias("seconds"),
        )
        for w in widths
    ]
    spread = df.select("activity_type", F.explode(F.array(*each)).alias("w")).select("w.*", "activity_type")
    return spread.groupBy("window_start", "window_end", "activity_type", "seconds").agg(F.count("*").alias("num_records"))


def flat_windows(counts: DataFrame) -> DataFrame:
    """Window bounds as columns of their own."""
    return counts.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *[c for c in counts.columns if c != "window"],
    )


def latest_windows(flat: DataFrame) -> DataFrame:
    return flat.orderBy(F.desc("window_start"), "activity_type")
