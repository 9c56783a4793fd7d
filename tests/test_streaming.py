import time

import pytest
from pyspark.sql import functions as F

from paceframe.operators import summaries
from paceframe.schemas import RAW_STREAM
from paceframe.sources.readers import rows
from paceframe.streaming import lifecycle, progress, sinks, sources, upsert, windows

KEYS = ("window_start", "window_end", "activity_type")


def event(second_of_day, activity, steps=10):
    clock = time.strftime("%H:%M:%S", time.gmtime(second_of_day))
    return (1, f"2024-01-01 {clock}", steps, 5.0, 80, 7.0, activity)


def drop_file(spark, folder, events):
    """One file with a later modification time than those before it."""
    rows(spark, events, RAW_STREAM).coalesce(1).write.mode("append").parquet(str(folder))
    time.sleep(0.05)


def stream_of(spark, folder):
    return sources.with_event_time(sources.file_stream(spark, str(folder)))


def flat_counts(stream):
    return windows.flat_windows(windows.windowed_counts(stream))


def test_one_file_per_batch_and_parsed_times(spark, tmp_path):
    for i in range(3):
        drop_file(spark, tmp_path / "in", [event(i, "yoga"), event(i, "running")])
    query = sinks.append_to_parquet(
        stream_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), trigger=sinks.AVAILABLE_NOW
    )
    lifecycle.finish(query)
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2, 2, 2]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and dict(out.dtypes)["timestamp"] == "timestamp"
    found = summaries.activity_breakdown_sql(out, "live").collect()
    assert [(r["activity_type"], r["num_records"]) for r in found] == [("running", 3), ("yoga", 3)]
    newest = summaries.latest(out, 1, "timestamp", ("activity_type",)).first()
    assert newest["activity_type"] == "running"


def counts_table(spark, path, **settings):
    return upsert.KeyedTable(spark, str(path), KEYS, ("window_start",), **settings)


def run_update(spark, tmp_path, table):
    query = upsert.upsert_to_table(
        flat_counts(stream_of(spark, tmp_path / "in")), table, str(tmp_path / "cp"), trigger=sinks.AVAILABLE_NOW
    )
    return lifecycle.finish(query)


def test_late_rows_are_dropped_one_batch_after_their_window_closed(spark, tmp_path):
    for second, activity in ((5, "run"), (300, "yoga"), (21, "run"), (22, "run"), (23, "run")):
        drop_file(spark, tmp_path / "in", [event(second, activity)])
    table = counts_table(spark, tmp_path / "table")
    query = run_update(spark, tmp_path, table)
    assert lifecycle.dropped_late_rows(query) == 2
    assert sorted((r["activity_type"], r["num_records"]) for r in table.read().collect()) == [("run", 2), ("yoga", 1)]


def test_updates_over_many_batches_equal_the_table(spark, tmp_path):
    batches = [[event(10 * i + j, "abc"[(i + j) % 3]) for j in range(9)] for i in range(5)]
    for batch in batches:
        drop_file(spark, tmp_path / "in", batch)
    table = counts_table(spark, tmp_path / "table", buckets=4)
    run_update(spark, tmp_path, table)
    rows_in = sources.with_event_time(spark.read.schema(RAW_STREAM).parquet(str(tmp_path / "in")))
    expected = flat_counts(rows_in)
    assert sorted(map(tuple, table.read().select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))
    # A batch for each file and one that closes windows; no trace of earlier ones but the last.
    assert table.version().batch >= 4
    assert len(list((tmp_path / "table" / "versions").glob("*.json"))) == 2


def test_a_restarted_query_continues_without_repeating_rows(spark, tmp_path):
    def run():
        query = sinks.append_to_parquet(
            stream_of(spark, tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), trigger=sinks.AVAILABLE_NOW
        )
        lifecycle.finish(query)

    drop_file(spark, tmp_path / "in", [event(1, "yoga")])
    run()
    drop_file(spark, tmp_path / "in", [event(2, "yoga"), event(3, "yoga")])
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_append_mode_holds_back_open_windows(spark, tmp_path):
    drop_file(spark, tmp_path / "in", [event(5, "run"), event(40, "run"), event(200, "run")])
    query = sinks.append_to_parquet(
        flat_counts(stream_of(spark, tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), trigger=sinks.AVAILABLE_NOW
    )
    lifecycle.finish(query)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_memory_table_and_lifecycle(spark, tmp_path):
    drop_file(spark, tmp_path / "in", [event(5, "run"), event(7, "run")])
    query = sinks.to_memory(flat_counts(stream_of(spark, tmp_path / "in")), "live_windows", "update")
    query.processAllAvailable()
    state = lifecycle.progress(query)
    assert state["active"] and state["name"] == "live_windows" and state["batch_id"] is not None
    assert spark.table("live_windows").first()["num_records"] == 2
    assert lifecycle.stop_named(spark, "live_windows")
    assert not query.isActive and not lifecycle.stop_named(spark, "live_windows")


def test_bad_event_times(spark):
    df = rows(spark, [(1, "no time", 1, 1.0, 1, 1.0, "yoga")], RAW_STREAM)
    assert sources.with_event_time(df, strict=False).first()["timestamp"] is None
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID"):
        sources.with_event_time(df).collect()


def test_windows_of_a_table_need_no_watermark(spark):
    df = sources.with_event_time(rows(spark, [event(5, "run"), event(29, "run"), event(30, "run")], RAW_STREAM))
    counts = windows.latest_windows(windows.flat_windows(windows.windowed_counts(df)))
    assert [r["num_records"] for r in counts.collect()] == [1, 2]
    assert counts.select(F.unix_timestamp("window_end") - F.unix_timestamp("window_start")).first()[0] == 30


def test_totals_cover_all_batches_and_restarts(spark, tmp_path):
    """More batches than a query remembers, with one late group each from the third on."""
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    late = 104
    try:
        with progress.ProgressLog(spark, str(tmp_path / "log")):
            for part in range(2):
                drop_file(spark, tmp_path / "in", [event(30_000 + part, "yoga")])
                for i in range(late // 2):
                    drop_file(spark, tmp_path / "in", [event(1 + i % 9, "run"), event(2, "run")])
                query = run_update(spark, tmp_path, counts_table(spark, tmp_path / "table", buckets=1))
                assert len(query.recentProgress) <= 100
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    found = progress.totals(spark, str(tmp_path / "log")).first()
    # The first batch behind the one that closes the windows is still taken.
    assert (found["num_input_rows"], found["num_late_groups"]) == (2 + 2 * late, late - 1)
    assert found["num_batches"] >= late + 2
