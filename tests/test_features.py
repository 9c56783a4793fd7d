import datetime as dt

import pytest
from pyspark.sql import functions as F

from paceframe.functions import columns as C
from paceframe.functions.features import add_features, add_partition_columns
from paceframe.plans import etl
from paceframe.schemas import FIVE_TIERS, FOUR_TIERS, PROCESSED, RAW_DAILY, check_schema
from paceframe.sources.readers import rows


def daily(spark, values):
    return rows(spark, values, "date string, steps bigint, calories_burned double").withColumn(
        "date", F.to_date("date")
    )


def test_features_by_day(spark):
    days = [("2024-02-29", 8000, 320.0), ("2024-03-03", 0, 95.5), ("2024-12-30", 1, 7.25)]
    out = add_features(daily(spark, days))
    found = {r["date"]: (r["day_of_week"], r["calories_to_steps_ratio"]) for r in out.collect()}
    assert found == {
        dt.date(2024, 2, 29): ("Thu", 0.04),
        dt.date(2024, 3, 3): ("Sun", 0.0),
        dt.date(2024, 12, 30): ("Mon", 7.25),
    }


@pytest.mark.parametrize("steps", [None, -1, 0])
def test_ratio_is_zero_without_positive_steps(spark, steps):
    out = add_features(daily(spark, [("2023-04-01", steps, 5.0)])).first()
    assert out["calories_to_steps_ratio"] == 0.0


def test_ratio_is_null_without_calories(spark):
    assert add_features(daily(spark, [("2023-04-01", 5, None)])).first()["calories_to_steps_ratio"] is None


def test_bad_dates_raise_or_become_null(spark):
    df = rows(spark, [("2023-13-99",)], "d string")
    with pytest.raises(Exception, match="CANNOT_PARSE|CAST_INVALID|DateTime"):
        df.select(C.parse_date("d")).collect()
    assert df.select(C.parse_date("d", strict=False).alias("d")).first()["d"] is None


def test_tiers_at_their_bounds(spark):
    df = rows(spark, [(v,) for v in (None, 0.0, 4999.9, 5000.0, 8000.0, 10000.0, 14999.0, 15000.0)], "v double")
    found = df.select(C.tier("v", FIVE_TIERS).alias("five"), C.tier("v", FOUR_TIERS).alias("four")).collect()
    assert [r["five"] for r in found] == [
        None, "Sedentary", "Sedentary", "Lightly Active", "Active", "Very Active", "Very Active", "Athlete",
    ]
    assert [r["four"] for r in found][-3:] == ["High Performer"] * 3


def test_text_helpers(spark):
    row = rows(spark, [("gym_workout", "x" * 60, 1234567.891, 12.345)], "a string, t string, n double, p double").select(
        C.label_text("a").alias("label"),
        C.preview_text("t").alias("shown"),
        C.thousands("n").alias("whole"),
        C.thousands("n", 2).alias("cents"),
        C.percent_text("p", 1).alias("pct"),
    ).first()
    assert row["label"] == "Gym Workout"
    assert row["shown"] == "x" * 50
    assert (row["whole"], row["cents"], row["pct"]) == ("1,234,568", "1,234,567.89", "12.3%")


def test_nan_becomes_null(spark):
    df = rows(spark, [(1.0, 1), (float("nan"), 2), (None, 3)], "x double, k int")
    assert C.nan_to_null(df).agg(F.count("x"), F.avg("x")).first()[:] == (1, 1.0)


def test_schema_check_names_the_column(spark):
    df = rows(spark, [(1, "2023-04-01")], "user_id bigint, date string")
    with pytest.raises(ValueError, match="steps: expected bigint, found nothing"):
        check_schema(df, RAW_DAILY)


def test_literal_rows_and_cast(spark):
    df = rows(spark, [("2023-04-01", 100, 10.0)], "date string, steps bigint, calories_burned double")
    assert df.withColumn("date", F.col("date").cast("date")).dtypes[0] == ("date", "date")
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def raw_rows():
    return [
        (u, f"2023-{m:02d}-{d:02d}", 100 * u, 10.0 * u, 80, 7.0, "yoga")
        for u in (1, 2)
        for m in (4, 5)
        for d in (1, 2, 3)
    ]


def test_etl_reads_a_tree_once_and_writes_months(spark, tmp_path):
    from paceframe.sources.writers import write_raw_layout

    raw = rows(spark, raw_rows(), RAW_DAILY)
    write_raw_layout(raw, str(tmp_path / "raw"))
    write_raw_layout(raw, str(tmp_path / "raw" / "copies"), "csv")
    out = str(tmp_path / "processed")
    result = etl.run(spark, str(tmp_path / "raw"), out)
    assert result == (True, 12, 0)
    table = spark.read.parquet(out)
    check_schema(table, PROCESSED)
    assert sorted(p.name for p in (tmp_path / "processed" / "year=2023").iterdir()) == ["month=4", "month=5"]
    assert table.count() == 12
    # Again: the table is replaced, not extended.
    assert etl.run(spark, str(tmp_path / "raw"), out).num_records == 12
    assert spark.read.parquet(out).count() == 12


def test_etl_without_input_writes_nothing(spark, tmp_path):
    assert etl.run(spark, str(tmp_path / "none"), str(tmp_path / "out")) == (False, 0, 0)
    (tmp_path / "empty").mkdir()
    assert etl.run(spark, str(tmp_path / "empty"), str(tmp_path / "out")) == (False, 0, 0)
    assert not (tmp_path / "out").exists()


def test_etl_counts_undated_rows(spark, tmp_path):
    bad = [(1, "2023-04-01", 1, 1.0, 80, 7.0, "yoga"), (1, "someday", 1, 1.0, 80, 7.0, "yoga")]
    rows(spark, bad, RAW_DAILY).write.parquet(str(tmp_path / "raw"))
    result = etl.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"), strict_dates=False)
    assert result == (True, 2, 1)


def test_partition_columns_are_plain_numbers(spark):
    row = add_partition_columns(daily(spark, [("2023-04-01", 1, 1.0)])).first()
    assert (row["year"], row["month"]) == (2023, 4)
