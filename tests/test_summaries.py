import datetime as dt

import pytest

from paceframe.operators import summaries
from paceframe.sources.readers import rows

SCHEMA = (
    "user_id bigint, date date, steps bigint, calories_burned double, heart_rate_avg bigint, "
    "sleep_hours double, activity_type string, day_of_week string"
)


@pytest.fixture(scope="module")
def telemetry(spark):
    day = dt.date
    return rows(
        spark,
        [
            (1, day(2023, 4, 1), 12000, 600.0, 130, 7.0, "running", "Sat"),
            (1, day(2023, 4, 2), 0, 200.0, 70, 8.0, "yoga", "Sun"),
            (2, day(2023, 4, 2), 3000, 300.0, 90, 6.0, "yoga", "Sun"),
            (2, day(2023, 5, 1), None, 100.0, 80, 7.5, "hiking", "Mon"),
            (None, day(2023, 5, 1), 5000, 250.0, 100, 7.0, "running", "Mon"),
        ],
        SCHEMA,
    )


def test_calendar_keeps_days_without_rows_in_order(telemetry):
    found = summaries.weekday_calendar_stats(telemetry).collect()
    assert [r["day_of_week"] for r in found] == ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    assert found[0]["num_records"] == 1 and found[1]["num_records"] is None


def test_overview(telemetry):
    row = summaries.kpi_overview(telemetry).first()
    assert (row["num_records"], row["num_users"], row["num_activities"], row["span_days"]) == (5, 2, 3, 30)
    assert row["avg_steps"] == 5000.0


def test_months_count_rows_with_a_user(telemetry):
    found = {r["month"]: r for r in summaries.monthly_summary(telemetry).collect()}
    assert (found["2023-05"]["num_records"], found["2023-05"]["num_users"]) == (1, 1)
    assert found["2023-04"]["num_users"] == 2


def test_mode_breaks_ties_by_name(telemetry):
    assert summaries.most_frequent(telemetry, "activity_type").first()["activity_type"] == "running"


def test_shares_leave_out_missing_values_and_add_up(spark):
    df = rows(spark, [("a",), ("a",), ("b",), (None,)], "c string")
    found = {r["c"]: r["share_pct"] for r in summaries.value_shares(df, "c").collect()}
    assert found == pytest.approx({"a": 200 / 3, "b": 100 / 3})


def test_share_above_counts_missing_steps_as_below(telemetry):
    assert summaries.high_performer_share(telemetry).first()["share_pct"] == 20.0


def test_efficiency_guards_against_zero_steps(telemetry):
    assert summaries.efficiency_by_totals(telemetry).first()["activity_type"] == "yoga"
    found = {r["activity_type"]: r["calories_per_step"] for r in summaries.efficiency_by_means(telemetry).collect()}
    assert found["yoga"] == 0.167 and found["hiking"] == 0.0


def test_top_activities(telemetry):
    found = {(r["user_id"], r["rank"]): r["activity_type"] for r in summaries.top_activities_per_user(telemetry, 1).collect()}
    assert found[(1, 1)] == "running" and found[(2, 1)] == "hiking"


def test_key_findings(telemetry):
    row = summaries.key_findings(telemetry).first()
    assert row["most_popular_activity"] == "running"
    assert row["most_efficient_activity"] == "yoga"
    assert row["sleep_quality"] == "Good" and row["num_activities"] == 3
    assert (row["min_hr"], row["max_hr"]) == (70, 130)


def test_document_is_one_consistent_row(telemetry, spark, tmp_path):
    from paceframe.sources.writers import write_json

    document = summaries.summary_document(telemetry, files=False)
    row = document.collect()
    assert len(row) == 1
    assert row[0]["dataset_overview"]["time_range"] == ["2023-04-01", "2023-05-01"]
    assert [m["month"] for m in row[0]["monthly_summary"]] == ["2023-04", "2023-05"]
    assert [a["activity_type"] for a in row[0]["activity_summary"]] == ["hiking", "running", "yoga"]
    write_json(document, str(tmp_path / "summary"))
    back = spark.read.json(str(tmp_path / "summary")).first()
    assert back["dataset_overview"]["num_records"] == 5


def test_preview_prints_schema_and_rows(telemetry, capsys):
    summaries.preview(telemetry, 1)
    shown = capsys.readouterr().out
    assert "activity_type: string" in shown and "only showing top 1 row" in shown


def test_total_of_shares_reuses_the_counts(spark, sf_dir):
    from paceframe.sources.adapters import event_telemetry

    df = summaries.value_shares(event_telemetry(spark, sf_dir), "activity_type")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
