"""Named streaming queries. Each reads the event or line table as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.operators import models, summaries
from paceframe.plans.registry import Registry, rounded
from paceframe.schemas import RAW_STREAM
from paceframe.session import scratch_path
from paceframe.sources.adapters import (
    EVENTS_SCHEMA,
    as_event_telemetry,
    as_line_telemetry,
    event_telemetry,
    line_telemetry,
    table,
)
from paceframe.streaming import lifecycle, progress, sinks, sources, upsert, windows

QUERIES = Registry()

WINDOW_KEYS = ("window_start", "window_end", "activity_type")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = sources.file_stream(spark, sf, EVENTS_SCHEMA, files_per_batch=None, glob="events.parquet")
    return as_event_telemetry(stream)


def _run_append(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is available into a Parquet table, and reads that table."""
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}_checkpoint")
    lifecycle.finish(sinks.append_to_parquet(stream, out, checkpoint, trigger=sinks.AVAILABLE_NOW))
    return spark.read.schema(stream.schema).parquet(out)


def _plain_times(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


def _staged_text_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events written out with text event times, read as a stream of that folder."""
    path = scratch_path(spark, "stream_input")
    text_time = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    rows = event_telemetry(spark, sf).withColumn("timestamp", text_time)
    rows.select(*RAW_STREAM.fieldNames()).write.parquet(path)
    return sources.with_event_time(sources.file_stream(spark, path))


@QUERIES.add
def stream_file_source(spark, sf):
    """Typed file stream: rows and steps per activity and day, as the files gave them."""
    stored = _run_append(
        spark, _event_stream(spark, sf).select("date", "activity_type", "steps"), "stream_file_source"
    )
    return stored.groupBy("date", "activity_type").agg(
        F.count("*").alias("num_records"), F.sum("steps").alias("sum_steps")
    )


@QUERIES.add
def stream_append_passthrough(spark, sf):
    """Text event times parsed on the way, rows appended."""
    stored = _run_append(spark, _staged_text_stream(spark, sf), "stream_append")
    return _plain_times(stored.drop("heart_rate_avg", "sleep_hours"), "timestamp").withColumnRenamed(
        "timestamp", "event_time"
    )


@QUERIES.add
def stream_activity_breakdown(spark, sf):
    """SQL on the table a stream has written."""
    stored = _run_append(spark, _staged_text_stream(spark, sf), "stream_breakdown")
    return summaries.activity_breakdown_sql(stored, "live_telemetry")


@QUERIES.add
def stream_window_append(spark, sf):
    """Closed windows only."""
    counts = windows.flat_windows(windows.windowed_counts(_event_stream(spark, sf)))
    return _plain_times(_run_append(spark, counts, "stream_windows"), "window_start", "window_end")


def _arrivals(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Events with the number of the delivery that brings them.

    The time span is delivered in two halves; error events come one delivery late.
    """
    events = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.struct(F.min(micros).alias("lo"), F.max(micros).alias("hi")).alias("s")).scalar()
    half = F.least(
        F.lit(1), F.floor((micros - F.col("_s.lo")) * 2 / (F.col("_s.hi") - F.col("_s.lo"))).cast("int")
    )
    delay = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return events.withColumn("_s", span).withColumn("arrival", half + delay).drop("_s"), 3


def _deliver_and_run(spark: SparkSession, arrivals: DataFrame, count: int, start) -> None:
    """Delivers the events part by part and resumes the same query after each delivery."""
    inbox = scratch_path(spark, "inbox")
    for number in range(count):
        due = arrivals.where(F.col("arrival") == number).drop("arrival")
        due.write.mode("append").parquet(inbox)
        stream = as_event_telemetry(sources.file_stream(spark, inbox, EVENTS_SCHEMA, files_per_batch=None))
        lifecycle.finish(start(stream))


UPDATE_DELIVERIES = 3
# Widths of the update query's windows, in seconds: events of all hours come in every delivery.
SLOT, HOUR = 30, 3600


@QUERIES.add
def stream_window_update(spark, sf):
    """Counts of every 30 seconds beside those of their hour, both kept in one keyed table: every
    delivery has events of all hours, so that windows change again and again."""
    path, checkpoint = scratch_path(spark, "window_table"), scratch_path(spark, "window_table_checkpoint")
    counts = upsert.KeyedTable(spark, path, (*WINDOW_KEYS, "seconds"), bucket_by=("window_start",), buckets=16)
    delivery = F.coalesce(F.pmod("event_id", F.lit(UPDATE_DELIVERIES)), F.lit(0))
    arrivals = table(spark, sf, "events").withColumn("arrival", delivery)

    def start(stream: DataFrame):
        nested = windows.nested_counts(stream, (SLOT, HOUR))
        return upsert.upsert_to_table(nested, counts, checkpoint, trigger=sinks.AVAILABLE_NOW)

    _deliver_and_run(spark, arrivals, UPDATE_DELIVERIES, start)
    stored = counts.read()
    slots = stored.where(F.col("seconds") == SLOT).alias("s")
    hours = stored.where(F.col("seconds") == HOUR).alias("h")
    of_hour = windows.window_start(F.col("s.window_start"), HOUR).eqNullSafe(F.col("h.window_start"))
    both = slots.join(hours, of_hour & F.col("s.activity_type").eqNullSafe(F.col("h.activity_type")))
    found = both.select(*[f"s.{c}" for c in (*WINDOW_KEYS, "num_records")], F.col("h.num_records").alias("hour_records"))
    return _plain_times(found, "window_start", "window_end")


@QUERIES.add
def stream_late_data(spark, sf):
    """Closed windows when a part of the events arrives after its windows were closed."""
    out, checkpoint = scratch_path(spark, "late"), scratch_path(spark, "late_checkpoint")

    def start(stream: DataFrame):
        flat = windows.flat_windows(windows.windowed_counts(stream))
        return sinks.append_to_parquet(flat, out, checkpoint, trigger=sinks.AVAILABLE_NOW)

    _deliver_and_run(spark, *_arrivals(spark, sf), start)
    return _plain_times(spark.read.parquet(out), "window_start", "window_end")


@QUERIES.add
def stream_late_totals(spark, sf):
    """Input rows and late groups of the late-data stream over all its deliveries and restarts."""
    out, checkpoint, log = (scratch_path(spark, n) for n in ("late", "late_checkpoint", "late_progress"))

    def start(stream: DataFrame):
        flat = windows.flat_windows(windows.windowed_counts(stream))
        return sinks.append_to_parquet(flat, out, checkpoint, trigger=sinks.AVAILABLE_NOW)

    with progress.ProgressLog(spark, log):
        _deliver_and_run(spark, *_arrivals(spark, sf), start)
    return progress.totals(spark, log).select("num_input_rows", "num_late_groups")


@QUERIES.add
def stream_window_latest(spark, sf):
    """Closed windows, latest first."""
    counts = windows.flat_windows(windows.windowed_counts(_event_stream(spark, sf)))
    stored = _run_append(spark, counts, "stream_latest")
    return _plain_times(windows.latest_windows(stored), "window_start", "window_end")


@QUERIES.add
def score_stream(spark, sf):
    """A fitted regression applied to a stream of the same table; means per activity."""
    fitted = models.fit_linear(line_telemetry(spark, sf))
    lines = table(spark, sf, "lineitem")
    stream = sources.file_stream(spark, sf, lines.schema, files_per_batch=None, glob="lineitem.parquet")
    scored = fitted.transform(as_line_telemetry(stream)).select("activity_type", "prediction")
    stored = _run_append(spark, scored, "scored")
    return rounded(
        stored.groupBy("activity_type").agg(
            F.count("*").alias("num_records"), F.avg("prediction").alias("avg_prediction")
        ),
        3,
    )
