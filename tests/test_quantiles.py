import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paceframe.operators import quantiles
from paceframe.operators.quantiles import aggregate_with_quantiles, quantile_rows

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def by_prob(df):
    return [r["value"] for r in df.orderBy("prob").collect()]


def expected(values):
    return list(np.quantile(np.array(values, dtype=float), PROBS))


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"x": np.array(values, dtype=float)}))


CASES = {
    "uniform": np.linspace(-5, 100, 5000),
    "one hot value": np.concatenate([np.full(2000, 7.0), np.linspace(0, 20, 3000)]),
    "all equal": np.full(3000, 2.5),
    "heavy tail": np.concatenate([np.exp(np.linspace(0, 300, 2000)), np.linspace(0, 1, 2000)]),
    "infinities": np.concatenate([np.full(700, -np.inf), np.linspace(0, 1, 1000), np.full(900, np.inf)]),
    "two extremes": np.concatenate([np.full(1500, -1e308), np.full(1500, 1e308), [0.0]]),
}


@pytest.mark.parametrize("case", CASES)
def test_located_quantiles_are_exact(spark, case):
    values = CASES[case]
    found = by_prob(quantile_rows(frame(spark, values), ("x",), PROBS, accuracy=100))
    ordered = np.sort(values)
    for prob, value in zip(PROBS, found):
        pos = prob * (len(values) - 1)
        low, high = ordered[int(np.floor(pos))], ordered[int(np.ceil(pos))]
        exact = low if low == high or pos == np.floor(pos) else (np.ceil(pos) - pos) * low + (pos - np.floor(pos)) * high
        assert value == pytest.approx(exact, rel=1e-12)


def test_both_ways_agree_per_group_with_missing_keys_and_values(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(
        {"g": rng.choice(["a", "b", "hot", "hot", "hot"], 4000), "x": rng.normal(size=4000), "y": rng.integers(0, 9, 4000)}
    )
    df = spark.createDataFrame(pdf).withColumns(
        {
            "g": F.when(F.col("g") != "b", F.col("g")),
            "x": F.when(F.col("x") > 1, None).when(F.col("x") < -2, float("nan")).otherwise(F.col("x")),
        }
    )
    small = quantile_rows(df, ("x", "y"), PROBS, ("g",))
    located = quantile_rows(df, ("x", "y"), PROBS, ("g",), accuracy=80)
    key = lambda r: (str(r["g"]), r["metric"], r["prob"])
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, located.collect()), key=str)
    assert len({key(r) for r in located.collect()}) == 3 * 2 * len(PROBS)


def test_figures_and_quantiles_come_together(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": ["a", "a", "b"], "x": [1.0, 3.0, 5.0]}))
    for limit in (8, 100):
        rows = aggregate_with_quantiles(df, ("x",), (0.5,), ("g",), [F.count("*").alias("n")], accuracy=limit)
        assert sorted((r["g"], r["n"], r["x__q"]) for r in rows.collect()) == [("a", 2, [2.0]), ("b", 1, [5.0])]


def test_empty_input_gives_nulls(spark):
    df = spark.createDataFrame([], "x double")
    row = aggregate_with_quantiles(df, ("x",), (0.5,), (), [F.count("*").alias("n")]).first()
    assert row["n"] == 0 and row["x__q"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_any_values(spark, values):
    found = by_prob(quantile_rows(frame(spark, values), ("x",), PROBS, accuracy=8))
    assert found == pytest.approx(expected(values), rel=1e-9, abs=1e-30)


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    """As if the sketch were far better than it is."""
    monkeypatch.setattr(quantiles, "ERROR_SCALE", 1e-6)
    values = np.random.default_rng(1).permutation(20_000) * 1.0
    assert by_prob(quantile_rows(frame(spark, values), ("x",), PROBS, accuracy=8)) == expected(values)


def test_two_scans_whatever_the_size(spark, tmp_path):
    """Every row of the file is read twice, once more than that only for other figures."""
    path = str(tmp_path / "t")
    spark.range(50_000).selectExpr("id * 37 % 50021 + 0.5 AS x", "id % 7 AS g").write.parquet(path)
    for by in ((), ("g",)):
        scans = spark.sparkContext.accumulator(0)

        @F.udf("double")
        def counted(x):
            scans.add(1)
            return x

        df = spark.read.parquet(path).withColumn("x", counted.asNondeterministic()("x"))
        quantile_rows(df, ("x",), (0.25, 0.5, 0.75), by, accuracy=64).collect()
        assert scans.value == 2 * 50_000
