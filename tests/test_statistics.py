import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paceframe.functions.columns import nan_to_null
from paceframe.functions.moments import kurtosis_sample, skewness_sample
from paceframe.operators import distributions, statistics
from paceframe.plans import table_queries
from paceframe.plans.oracle import ORACLE
from paceframe.sources.readers import rows


@pytest.fixture(scope="module")
def telemetry(spark):
    rng = np.random.default_rng(1)
    n = 2000
    pdf = pd.DataFrame(
        {
            "user_id": rng.integers(1, 40, n),
            "activity_type": rng.choice(["yoga", "running", "hiking"], n),
            "steps": rng.integers(0, 20000, n),
            "calories_burned": np.round(rng.gamma(2.0, 300.0, n), 2),
            "heart_rate_avg": rng.integers(60, 170, n),
            "sleep_hours": np.round(rng.uniform(4, 10, n), 2),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_shape_of_a_small_sample(spark):
    df = rows(spark, [(1.0,), (2.0,), (2.0,), (3.0,), (10.0,)], "x double")
    skew, kurt = df.agg(skewness_sample("x"), kurtosis_sample("x")).first()
    assert skew == pytest.approx(2.0286991020803327)
    assert kurt == pytest.approx(4.2721465317)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_shape_needs_enough_values(spark, n):
    df = rows(spark, [(float(i * i),) for i in range(n)], "x double")
    skew, kurt = df.agg(skewness_sample("x"), kurtosis_sample("x")).first()
    assert (skew is None) == (n < 3) and kurt is None


def test_detailed_statistics_equal_pandas(telemetry):
    pdf, df = telemetry
    found = {r["metric"]: r for r in statistics.detailed_statistics(df, digits=None).collect()}
    for metric, row in found.items():
        s = pdf[metric]
        expected = dict(
            mean=s.mean(), median=s.median(), std=s.std(), min=s.min(), max=s.max(), q1=s.quantile(0.25),
            q3=s.quantile(0.75), iqr=s.quantile(0.75) - s.quantile(0.25), skewness=s.skew(), kurtosis=s.kurtosis(),
        )
        for name, value in expected.items():
            assert row[name] == pytest.approx(value, rel=1e-9), (metric, name)


def test_describe_equals_pandas(telemetry):
    pdf, df = telemetry
    for row in statistics.describe_quartiles(df).collect():
        s = pdf[row["metric"]]
        assert row["count"] == s.count() and row["variance"] == pytest.approx(s.var())
        assert (row["q1"], row["median"], row["q3"]) == pytest.approx(tuple(s.quantile([0.25, 0.5, 0.75])))


def test_activity_stats_equal_pandas(telemetry):
    pdf, df = telemetry
    expected = pdf.groupby("activity_type")[["steps", "calories_burned"]].agg(["mean", "median", "std"])
    for row in statistics.activity_stats(df, digits=None).collect():
        e = expected.loc[row["activity_type"]]
        assert row["median_steps"] == pytest.approx(e[("steps", "median")])
        assert row["std_calories"] == pytest.approx(e[("calories_burned", "std")])


def test_correlations_equal_pandas_with_gaps(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, None, 9], "b": [2.0, 4, 7, 1, None], "c": [5.0] * 5})
    df = spark.createDataFrame(pdf).select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns]
    )
    found = {(r[0], r[1]): r[2] for r in statistics.correlation_matrix(df, ("a", "b", "c")).collect()}
    assert found[("a", "b")] == found[("b", "a")] == pytest.approx(pdf["a"].corr(pdf["b"]))
    assert found[("a", "a")] == 1.0 and found[("c", "c")] is None


def test_trend_line(spark):
    df = rows(spark, [("x", 1, 2.0), ("x", 2, 4.0), ("x", 3, 7.0)], "activity_type string, steps int, calories_burned double")
    row = statistics.trend_lines(df).first()
    assert (row["slope"], row["intercept"], row["r2"]) == pytest.approx((2.5, -2 / 3, 0.9868421052631579))


def test_constants_have_no_trend_and_no_shape(spark):
    df = rows(spark, [("x", 1, 2.0)] * 5, "activity_type string, steps int, calories_burned double")
    row = statistics.trend_lines(df).first()
    assert row["slope"] is None and row["r2"] is None and row["num_points"] == 5
    assert df.agg(skewness_sample("steps"), kurtosis_sample("steps")).first()[:] == (0.0, 0.0)


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = rows(spark, [(0.0,), (0.5,), (9.0,), (10.0,), (None,)], "x double")
    counts = [r["num_records"] for r in distributions.histogram(df, "x", 10).orderBy("bin").collect()]
    assert counts == [2, 0, 0, 0, 0, 0, 0, 0, 0, 2]


def test_histogram_of_a_constant_has_one_bin(spark):
    df = rows(spark, [(3.0,)] * 4, "x double")
    assert [tuple(r) for r in distributions.histogram(df, "x", 10).select("bin", "num_records").collect()] == [(0, 4)]


def test_histogram_equals_numpy(telemetry):
    pdf, df = telemetry
    counts = [r["num_records"] for r in distributions.histogram(df, "calories_burned", 50).orderBy("bin").collect()]
    assert counts == list(np.histogram(pdf["calories_burned"], bins=50)[0])


def test_box_whiskers_stop_inside_the_fences(telemetry):
    pdf, df = telemetry
    row = distributions.box_summary(df, "calories_burned").first()
    q1, q3 = pdf["calories_burned"].quantile([0.25, 0.75])
    inside = pdf["calories_burned"][pdf["calories_burned"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    assert (row["whisker_low"], row["whisker_high"]) == (inside.min(), inside.max())
    groups = distributions.box_summary(df, "steps", ("activity_type",), accuracy=100).collect()
    assert len(groups) == 3


def test_density_integrates_to_one(telemetry):
    _, df = telemetry
    points = distributions.density_curve(df, "steps").orderBy("point").toPandas()
    assert np.trapezoid(points["density"], points["x"]) == pytest.approx(1.0, abs=0.02)


@pytest.mark.parametrize("sigma", [0.3, 1.5, 4.0])
def test_density_of_long_tails_equals_the_direct_sum(spark, sigma):
    values = np.exp(np.random.default_rng(5).normal(0, sigma, 5000))
    df = spark.createDataFrame(pd.DataFrame({"x": [*values, None, float("nan")]}))
    found = distributions.density_curve(nan_to_null(df), "x").orderBy("point").collect()
    assert 10 < len(found) <= 512
    spread = min(values.std(ddof=1), (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / 1.349)
    bw = 1.059 * spread * len(values) ** -0.2
    x = np.array([r["x"] for r in found])
    direct = np.exp(-0.5 * ((x[:, None] - values[None]) / bw) ** 2).sum(axis=1) / (len(values) * bw * np.sqrt(2 * np.pi))
    assert np.abs(np.array([r["density"] for r in found]) - direct).max() < 1e-9 * direct.max()
    assert x[0] == pytest.approx(values.min() - 2 * bw) and x[-1] == pytest.approx(values.max() + 2 * bw) and (np.diff(x) > 0).all()


def test_density_grid_keeps_its_step_beyond_512_points(spark):
    values = np.random.default_rng(6).exponential(50, 4000)
    values[0] = 3000.0
    curve = distributions.density_curve(spark.createDataFrame(pd.DataFrame({"x": values})), "x", even=True)
    found = curve.orderBy("point").collect()
    bw = 1.059 * (np.quantile(values, 0.75) - np.quantile(values, 0.25)) / 1.349 * len(values) ** -0.2
    lo, span = values.min() - 2 * bw, np.ptp(values) + 4 * bw
    steps = int(np.ceil(span / (bw / 3)))
    assert steps > 512 and [r["point"] for r in found] == list(range(steps + 1))
    x = lo + np.arange(steps + 1) * (span / steps)
    direct = np.exp(-0.5 * ((x[:, None] - values[None]) / bw) ** 2).sum(axis=1) / (len(values) * bw * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in found], x) and np.abs([r["density"] for r in found] - direct).max() < 1e-9 * direct.max()


def test_density_query_equals_its_sql_beyond_512_points(spark, tmp_path):
    drawn = np.random.default_rng(7).exponential(50, 3000)
    drawn[:1] = 3000.0
    frame = pd.DataFrame({"event_id": range(3000), "user_id": 1, "event_type": "view", "value": drawn.round(2), "props": '{"k": 1}'})
    frame["ts"] = pd.Timestamp("2024-01-01")
    spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = [tuple(r) for r in table_queries.QUERIES["density_grid"](spark, str(tmp_path)).orderBy("point").collect()]
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = duck.execute(f"SELECT point, x, density FROM ({ORACLE['density_grid']}) ORDER BY point").fetchall()
    assert len(wanted) > 512 and len(found) == len(wanted) and np.allclose(found, wanted, rtol=0, atol=2e-6)


def test_density_without_spread_has_no_rows(spark):
    for values in ([], [3.0], [3.0, 3.0], [1.0, float("inf")]):
        assert distributions.density_curve(rows(spark, [(v,) for v in values], "x double"), "x").count() == 0
