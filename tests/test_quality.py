import pandas as pd
from pyspark.sql import functions as F

from paceframe.operators import quality
from paceframe.schemas import ValidRange
from paceframe.sources.readers import rows


def keyed(df, key):
    return {r[key]: r for r in df.collect()}


def test_nan_and_null_both_count_as_missing(spark):
    df = rows(spark, [(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert {k: r["missing"] for k, r in keyed(quality.null_counts(df), "column").items()} == {"x": 2, "s": 1}
    report = keyed(quality.completeness_report(df), "column")
    assert report["x"]["complete_pct"] == 33.33 and report["s"]["complete_pct"] == 66.67


def test_reports_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert {r["complete_pct"] for r in quality.completeness_report(df).collect()} == {None}
    assert quality.duplicate_report(df).first()[:] == (0, 0, None, 0)
    assert quality.validity_report(df, [ValidRange("x", 0, 1, "")]).first()["valid_pct"] is None


def test_duplicates_equal_pandas_and_count_missing_values_as_equal(spark):
    pdf = pd.DataFrame({"a": [1, 1, 2, 3, 3, 3], "s": ["x", "x", None, None, None, "y"]})
    df = spark.createDataFrame(pdf)
    for digest in ((), ("s",)):
        row = quality.duplicate_report(df, digest).first()
        assert row["duplicates"] == pdf.duplicated().sum() == 2
        assert row["unique_records"] == 4


def test_a_third_of_the_rows_in_one_copy(spark):
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id")).alias("k"))
    assert quality.duplicate_report(hot).first()["duplicates"] == 999


def test_bounds_of_the_valid_range_are_valid(spark):
    df = rows(spark, [(0,), (10,), (-1,), (11,), (None,)], "x int")
    row = quality.validity_report(df, [ValidRange("x", 0, 10, "rule")]).first()
    assert (row["out_of_range"], row["valid_pct"], row["expected_range"]) == (2, 60.0, "0-10")


def test_outliers_and_inliers_split_the_rows(spark):
    df = rows(spark, [(float(v),) for v in [*range(100), 1000, -1000]], "x double")
    for limit in (10, 1000):
        assert sorted(r["x"] for r in quality.outlier_rows(df, "x", limit).collect()) == [-1000.0, 1000.0]
        assert quality.inlier_rows(df, "x", limit).count() == 100
    report = quality.outlier_report(df, ("x",)).first()
    assert (report["total_records"], report["outliers"]) == (102, 2)


def test_profile_shows_the_first_row(spark):
    df = rows(spark, [(2, "b"), (1, "z" * 70), (2, None)], "k int, s string")
    found = keyed(quality.column_profile(df), "column")
    assert found["k"]["sample_value"] == "1" and found["s"]["sample_value"] == "z" * 50
    assert (found["k"]["unique_values"], found["s"]["unique_values"]) == (2, 2)
    assert found["s"]["data_type"] == "string"


def test_column_profile_repeats_no_row(spark):
    df = rows(spark, [(1, "a", None), (1, "b", 2.0), (2, "b", 2.0)], "k int, name string, x double")
    found = quality.column_profile(df)
    assert "Expand" not in found._jdf.queryExecution().toString()
    assert [(r["column"], r["unique_values"]) for r in found.collect()] == [("k", 2), ("name", 2), ("x", 1)]
    assert [(r["column"], r["unique_values"]) for r in quality.column_profile(df.where("false")).collect()] == [("k", 0), ("name", 0), ("x", 0)]
