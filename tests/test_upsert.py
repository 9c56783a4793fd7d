import datetime as dt

import pytest

from paceframe.plans import stream_queries
from paceframe.sources.readers import rows
from paceframe.streaming.upsert import KeyedTable

SCHEMA = "day int, name string, n int"


def keyed(spark, path, **settings):
    return KeyedTable(spark, str(path), ("day", "name"), ("day",), **settings)


def found(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def folders(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("data/*/*=*"))


def test_changes_replace_rows_of_their_keys(spark, tmp_path):
    table = keyed(spark, tmp_path, buckets=8)
    with pytest.raises(FileNotFoundError):
        table.read()
    table.merge(rows(spark, [(1, "a", 1), (2, "a", 1), (None, None, 5)], SCHEMA), 0)
    table.merge(rows(spark, [(1, "a", 2), (1, "b", 1), (None, None, 6), (3, None, 1)], SCHEMA), 1)
    assert found(table) == sorted([(1, "a", 2), (1, "b", 1), (2, "a", 1), (None, None, 6), (3, None, 1)], key=repr)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.merge(rows(spark, [(1, "a", 1)], SCHEMA), 0)
    first = table.merge(rows(spark, [(1, "a", 2)], SCHEMA), 1)
    again = keyed(spark, tmp_path)
    assert again.merge(rows(spark, [(1, "a", 9)], SCHEMA), 1) == first
    assert again.merge(rows(spark, [(1, "a", 9)], SCHEMA), 0) == first
    assert found(again) == [(1, "a", 2)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = keyed(spark, tmp_path, buckets=8)
    first = table.merge(rows(spark, [(day, "a", 1) for day in range(40)], SCHEMA), 0)
    second = table.merge(rows(spark, [(7, "a", 2)], SCHEMA), 1)
    assert len(first.folders) == 8 and set(first.folders.values()) == {1}
    assert sorted(second.folders.values()) == [1] * 7 + [2]
    assert len(folders(tmp_path)) == 9


def test_an_unfinished_batch_is_unseen_and_repeated(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path)
    table.merge(rows(spark, [(1, "a", 1)], SCHEMA), 0)

    def fail(path, text):
        raise OSError("lost")

    monkeypatch.setattr(table.files, "put", fail)
    with pytest.raises(OSError):
        table.merge(rows(spark, [(1, "a", 2), (2, "b", 1)], SCHEMA), 1)
    again = keyed(spark, tmp_path)
    assert found(again) == [(1, "a", 1)]
    again.merge(rows(spark, [(1, "a", 3)], SCHEMA), 1)
    assert found(again) == [(1, "a", 3)]


def test_the_table_stays_as_large_as_its_rows(spark, tmp_path):
    table = keyed(spark, tmp_path, buckets=4)
    for batch in range(12):
        table.merge(rows(spark, [(day, "a", batch) for day in range(batch % 3, 9, 3)], SCHEMA), batch)
    assert len(folders(tmp_path)) <= 8 and len(list((tmp_path / "versions").glob("*.json"))) == 2
    assert found(table) == [(day, "a", 9 + day % 3) for day in range(9)]


def test_empty_batches_and_other_keys(spark, tmp_path):
    table = keyed(spark, tmp_path)
    table.merge(rows(spark, [], SCHEMA), 0)
    assert table.version().batch == 0 and found(table) == []
    with pytest.raises(ValueError, match="keyed by"):
        KeyedTable(spark, str(tmp_path), ("name",)).version()
    with pytest.raises(ValueError, match="key columns"):
        KeyedTable(spark, str(tmp_path), ("name",), ("n",))


def test_a_second_writer_fails_to_commit(spark, tmp_path):
    table, other = keyed(spark, tmp_path), keyed(spark, tmp_path)
    table.merge(rows(spark, [(1, "a", 1)], SCHEMA), 0)
    before = other.version()
    table.merge(rows(spark, [(1, "a", 2)], SCHEMA), 1)
    with pytest.raises(FileExistsError):
        other._merge(rows(spark, [(1, "a", 3)], SCHEMA), 1, before)


def test_windows_of_the_query_change_in_every_delivery(spark, sf_dir, monkeypatch):
    merged = []
    merge = KeyedTable.merge

    def noted(self, changes, batch):
        merged.append({tuple(r)[:3] for r in changes.collect()})
        return merge(self, changes, batch)

    monkeypatch.setattr(KeyedTable, "merge", noted)
    total = stream_queries.QUERIES["stream_window_update"](spark, sf_dir).agg({"num_records": "sum"}).first()[0]
    full = [m for m in merged if m]
    assert len(full) == stream_queries.UPDATE_DELIVERIES and all(len(a & b) > 10 for a, b in zip(full, full[1:]))
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_every_event_is_in_a_window_of_30_seconds(spark, tmp_path):
    times = [f"2024-01-01 {t}" for t in ("00:00:01", "00:00:29.5", "00:00:30", "00:59:59", "01:00:00", "00:00:02")]
    events = [(i, t, 1, "view", 1.0, '{"k": 1}') for i, t in enumerate(times)]
    events += [(None, "2024-01-01 00:00:03", 1, "view", 1.0, '{"k": 1}'), (9, None, 1, "view", 1.0, "{}"), (10, times[0], 1, None, 1.0, "{}")]
    frame = rows(spark, events, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    frame.withColumn("ts", frame["ts"].cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = stream_queries.QUERIES["stream_window_update"](spark, str(tmp_path)).collect()

    def of(start, activity, n, hour):
        at = None if start is None else dt.datetime.fromisoformat(f"2024-01-01 {start}")
        return at, at and at + dt.timedelta(seconds=30), activity, n, hour

    wanted = [
        of("00:00:00", "view", 4, 6), of("00:00:30", "view", 1, 6), of("00:59:30", "view", 1, 6),
        of("01:00:00", "view", 1, 1), of(None, "view", 1, 1), of("00:00:00", None, 1, 1),
    ]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)
