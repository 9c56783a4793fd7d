import math

import pytest

from paceframe.operators import metrics
from paceframe.sources.readers import rows

PAIRS = [("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("b", "a"), ("c", "z")]


@pytest.fixture(scope="module")
def scored(spark):
    return rows(spark, PAIRS, "label string, prediction string")


def test_accuracy(scored):
    assert metrics.accuracy(scored).first()["accuracy"] == pytest.approx(4 / 7)


def test_grid_has_every_pair_of_actual_labels(scored):
    found = {(r["label"], r["prediction"]): r["num_rows"] for r in metrics.confusion_grid(scored).collect()}
    assert found == {(x, y): PAIRS.count((x, y)) for x in "abc" for y in "abc"}


def test_report_covers_unseen_predictions_and_empty_classes(scored):
    found = {r["name"]: r for r in metrics.classification_report(scored).collect()}
    assert (found["a"]["precision"], found["a"]["recall"]) == (0.75, 0.75)
    assert found["z"]["support"] == 0 and found["z"]["f1"] == 0.0
    assert found["c"]["recall"] == 0.0
    assert found["accuracy"]["f1"] == pytest.approx(4 / 7)
    assert found["macro avg"]["recall"] == pytest.approx((0.75 + 0.5 + 0 + 0) / 4)
    assert found["weighted avg"]["recall"] == pytest.approx((4 * 0.75 + 2 * 0.5) / 7)
    assert found["weighted avg"]["support"] == 7


def test_regression_figures(spark):
    df = rows(spark, [(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "y double, prediction double")
    row = metrics.regression_metrics(df, "y").first()
    assert row["rmse"] == pytest.approx(math.sqrt(2 / 3))
    assert row["r2"] == pytest.approx(1 - 2 / (42 / 9))
    assert [r["residual"] for r in metrics.residuals(df, "y").orderBy("y").collect()] == [-1.0, 0.0, 1.0]


def test_r2_of_a_constant_label_is_null(spark):
    df = rows(spark, [(1.0, 2.0), (1.0, 1.0)], "y double, prediction double")
    assert metrics.regression_metrics(df, "y").first()["r2"] is None
