import datetime as dt

import pytest
from pyspark.sql import functions as F

from paceframe.operators.summaries import dataset_overview, with_file
from paceframe.schemas import RAW_DAILY
from paceframe.session import materialise, shared_dir
from paceframe.sources import readers, writers
from paceframe.sources.adapters import line_telemetry
from paceframe.functions.features import add_features, add_partition_columns


@pytest.fixture(scope="module")
def processed(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "processed")
    writers.write_processed(add_partition_columns(add_features(line_telemetry(spark, sf_dir))), path)
    return path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_range_prunes_folders_and_is_exact(spark, sf_dir, processed):
    start, end = dt.date(1996, 3, 15), dt.date(1997, 2, 10)
    df = readers.read_processed(spark, processed, start, end)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "PartitionFilters: [isnotnull(year" in text
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in text
    expected = line_telemetry(spark, sf_dir).where(F.col("date").between(F.lit(start), F.lit(end)))
    assert df.count() == expected.count() > 0


def test_only_needed_columns_are_read(spark, processed):
    df = readers.read_processed(spark, processed).groupBy("day_of_week").agg(F.avg("steps"))
    assert "ReadSchema: struct<steps:bigint,day_of_week:string>" in plan(df)


def test_static_overwrite_replaces_all_and_dynamic_only_what_is_there(spark, tmp_path):
    def month(m):
        return readers.rows(spark, [(1, 2023, m)], "v int, year int, month int")

    both = str(tmp_path / "static")
    writers.write_processed(month(4).union(month(5)), both)
    writers.write_processed(month(4), both)
    assert {r["month"] for r in spark.read.parquet(both).collect()} == {4}
    kept = str(tmp_path / "dynamic")
    writers.write_processed(month(4).union(month(5)), kept)
    writers.write_processed(month(4), kept, overwrite="dynamic")
    assert sorted(r["month"] for r in spark.read.parquet(kept).collect()) == [4, 5]


def test_rebalanced_write_makes_few_files(spark, sf_dir, tmp_path):
    lines = add_partition_columns(line_telemetry(spark, sf_dir)).repartition(8)
    writers.write_processed(lines, str(tmp_path / "t"))
    files = list((tmp_path / "t").rglob("*.parquet"))
    folders = {f.parent for f in files}
    assert len(files) < 2 * len(folders)


def test_raw_layout_pads_months_and_days(spark, tmp_path):
    df = readers.rows(spark, [(1, "2023-04-05", 1, 1.0, 1, 1.0, "yoga")], RAW_DAILY)
    writers.write_raw_layout(df, str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "year=2023" / "month=04" / "day=05").is_dir()


def test_missing_paths_give_an_empty_typed_frame(spark, tmp_path):
    df = readers.read_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")], RAW_DAILY)
    assert df.schema == RAW_DAILY and df.isEmpty()


def test_concat_fills_absent_columns(spark):
    a = readers.rows(spark, [(1, "x")], "k int, only_a string")
    b = readers.rows(spark, [(2,)], "k int")
    assert sorted((r["k"], r["only_a"]) for r in readers.concat([a, b]).collect()) == [(1, "x"), (2, None)]


def test_overview_counts_files(spark, tmp_path):
    path = str(tmp_path / "days")
    for day in ("2023-04-01", "2023-04-02"):
        row = (1, day, 1, 1.0, 1, 1.0, "yoga")
        readers.rows(spark, [row], RAW_DAILY).write.mode("append").parquet(path)
    row = dataset_overview(with_file(readers.read_tree(spark, path, RAW_DAILY))).first()
    assert (row["total_files"], row["num_records"], row["num_users"]) == (2, 2, 1)


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured
    df = materialise(spark.range(10))
    assert df.count() == 10 and "FileScan parquet" in plan(df)


def days(spark, *values):
    return readers.rows(spark, [(k, f"2023-04-{d:02d}", 1, 1.0, 1, 1.0, "yoga") for k, d in values], RAW_DAILY)


def by_format(spark, root):
    formats = (readers.read_tree(spark, root, RAW_DAILY), readers.read_csv_tree(spark, root, RAW_DAILY))
    return [sorted((r["user_id"], r["date"]) for r in f.collect()) for f in formats]


def test_formats_live_side_by_side(spark, tmp_path):
    root = str(tmp_path / "raw")
    writers.write_raw_layout(days(spark, (1, 5), (2, 6)), root, "parquet", "csv")
    both = [(1, "2023-04-05"), (2, "2023-04-06")]
    assert by_format(spark, root) == [both, both]
    writers.write_raw_layout(days(spark, (3, 6), (4, 7)), root, "csv")
    assert by_format(spark, root) == [both, [(3, "2023-04-06"), (4, "2023-04-07")]]
    assert {f.name for f in (tmp_path / "raw").iterdir()} == {"year=2023"}
    day = tmp_path / "raw" / "year=2023" / "month=04" / "day=06"
    assert sorted(f.suffix for f in day.iterdir() if not f.name.startswith(".")) == [".csv", ".parquet"]
    with pytest.raises(ValueError, match="formats"):
        writers.write_raw_layout(days(spark, (1, 5)), root, "xml")


def test_a_failed_write_leaves_the_old_files(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "raw")
    old = [(1, "2023-04-05")]
    writers.write_raw_layout(days(spark, (1, 5)), root, "parquet", "csv")
    with pytest.raises(Exception):  # noqa: B017
        writers.write_raw_layout(days(spark, (2, 6)).withColumn("steps", F.raise_error(F.lit("lost"))), root, "parquet", "csv")
    assert by_format(spark, root) == [old, old]

    def fail(self, path, text, replace=False):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(writers.Files, "put", fail)
        with pytest.raises(OSError):
            writers.write_raw_layout(days(spark, (2, 6)), root, "parquet")
    assert by_format(spark, root) == [old, old]
    # What failed writes have left goes with the next one.
    writers.write_raw_layout(days(spark, (2, 6)), root, "parquet")
    assert by_format(spark, root) == [[(2, "2023-04-06")], old]
    assert not list((tmp_path / "raw").glob("_*"))


@pytest.mark.parametrize("steps", range(6))
def test_a_write_with_a_manifest_is_completed(spark, tmp_path, monkeypatch, steps):
    root = str(tmp_path / "raw")
    writers.write_raw_layout(days(spark, (1, 5), (2, 6)), root, "parquet", "csv")
    done = []

    def some(method):
        def run(self, *args):
            if len(done) == steps:
                raise OSError("lost")
            done.append(args)
            return method(self, *args)

        return run

    new = [(3, "2023-04-06"), (4, "2023-04-08")]
    with monkeypatch.context() as patch:
        put = writers.Files.put

        def then_fail(self, *args, **more):
            put(self, *args, **more)
            for name in ("move", "remove"):
                patch.setattr(writers.Files, name, some(getattr(writers.Files, name)))

        patch.setattr(writers.Files, "put", then_fail)
        with pytest.raises(OSError):
            writers.write_raw_layout(days(spark, (3, 6), (4, 8)), root, "parquet", "csv")
    assert writers.finish_raw_layout(spark, root) and not writers.finish_raw_layout(spark, root)
    assert by_format(spark, root) == [new, new]
