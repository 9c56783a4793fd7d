"""The registered queries as plain SQL over the same tables, for an independent check.

Written by hand against the table definitions; nothing here is derived from the DataFrame code.
"""

from __future__ import annotations

LINES = """
  SELECT l_suppkey AS user_id,
         CAST(l_shipdate AS DATE) AS date,
         CAST(l_quantity AS BIGINT) AS steps,
         l_extendedprice AS calories_burned,
         CAST(round(l_discount * 100) AS BIGINT) AS heart_rate_avg,
         round(l_tax * 100) AS sleep_hours,
         l_returnflag || l_linestatus AS activity_type
  FROM lineitem
"""

EVENTS = """
  SELECT event_id, user_id, CAST(ts AS DATE) AS date, ts AS event_time,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS steps,
         value AS calories_burned,
         CAST(NULL AS BIGINT) AS heart_rate_avg,
         CAST(NULL AS DOUBLE) AS sleep_hours,
         event_type AS activity_type
  FROM events
"""

METRICS = ("steps", "calories_burned", "heart_rate_avg", "sleep_hours")
ALL_MEANS = """round(avg(steps), 6) AS avg_steps, round(avg(calories_burned), 6) AS avg_calories,
       round(avg(heart_rate_avg), 6) AS avg_hr, round(avg(sleep_hours), 6) AS avg_sleep"""
RATIO = "CASE WHEN steps > 0 THEN calories_burned / steps ELSE 0 END"
WEEKDAY = "strftime(date, '%a')"


def lines(body: str) -> str:
    return f"WITH t AS ({LINES})\n{body}"


def events(body: str) -> str:
    return f"WITH t AS ({EVENTS})\n{body}"


def per_metric(template: str, metrics: tuple[str, ...] = METRICS) -> str:
    return "\nUNION ALL\n".join(template.replace("$m", m) for m in metrics)


ORACLE: dict[str, str] = {}

# Sources

_RAW = """SELECT user_id, CAST(date AS VARCHAR) AS date, steps, calories_burned, heart_rate_avg,
       sleep_hours, activity_type FROM t"""

ORACLE["scan_recursive"] = events(_RAW)
ORACLE["scan_glob_filter"] = events(_RAW)
ORACLE["scan_partitioned"] = lines(
    """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       count(*) AS num_records, round(sum(calories_burned), 2) AS sum_calories
FROM t GROUP BY 1, 2"""
)
ORACLE["scan_missing_is_empty"] = "SELECT event_type, count(*) AS num_records FROM events GROUP BY 1"
ORACLE["concat_daily"] = f"""
SELECT CAST(NULL AS BIGINT) AS event_id, user_id, date, steps, calories_burned, activity_type FROM ({LINES})
UNION ALL
SELECT event_id, user_id, date, steps, calories_burned, activity_type FROM ({EVENTS})"""

# Sinks

ORACLE["etl_roundtrip"] = lines(
    f"""SELECT user_id, date, steps, calories_burned, heart_rate_avg, sleep_hours, activity_type,
       {WEEKDAY} AS day_of_week, {RATIO} AS calories_to_steps_ratio,
       CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month
FROM t"""
)
ORACLE["raw_layout_parquet_roundtrip"] = events(
    """SELECT year(date) AS year, month(date) AS month, day(date) AS day,
       count(*) AS num_records, CAST(sum(steps) AS BIGINT) AS sum_steps
FROM t GROUP BY 1, 2, 3"""
)
ORACLE["raw_layout_csv_roundtrip"] = events(_RAW)
ORACLE["raw_layout_twins"] = events(
    """SELECT format, CAST(date AS VARCHAR) AS date, count(*) AS num_records, CAST(sum(steps) AS BIGINT) AS sum_steps
FROM t, (VALUES ('parquet', -1), ('csv', 50)) f(format, least) WHERE least < 0 OR steps > least GROUP BY 1, 2"""
)
ORACLE["summary_document"] = lines(
    f""", o AS (SELECT count(*) AS all_records, CAST(min(date) AS VARCHAR) AS first_date,
           CAST(max(date) AS VARCHAR) AS last_date FROM t),
p AS (
  SELECT 'monthly_summary' AS section, strftime(date, '%Y-%m') AS name, * FROM t
  UNION ALL
  SELECT 'activity_summary' AS section, activity_type AS name, * FROM t
)
SELECT section, name, any_value(all_records) AS all_records, any_value(first_date) AS first_date,
       any_value(last_date) AS last_date, count(user_id) AS num_records,
       count(DISTINCT user_id) AS num_users, {ALL_MEANS}
FROM p, o GROUP BY section, name"""
)

# Expressions

ORACLE["parse_date"] = events("SELECT event_id, CASE WHEN steps <> 0 THEN date END AS date FROM t")
ORACLE["parse_timestamp"] = events(
    "SELECT event_id, CASE WHEN steps <> 0 THEN date_trunc('second', event_time) END AS event_time FROM t"
)
ORACLE["day_of_week"] = events(f"SELECT event_id, {WEEKDAY} AS day_of_week FROM t")
ORACLE["guarded_ratio"] = events(f"SELECT event_id, {RATIO} AS calories_to_steps_ratio FROM t")
ORACLE["date_parts"] = lines(
    """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
       strftime(date, '%Y-%m') AS period, count(*) AS num_records
FROM t GROUP BY 1, 2, 3"""
)
ORACLE["transform_features"] = events(
    f"""SELECT event_id, user_id, date, steps, calories_burned, activity_type,
       {WEEKDAY} AS day_of_week, {RATIO} AS calories_to_steps_ratio
FROM t"""
)
ORACLE["project_rename"] = events(
    "SELECT event_id, user_id AS athlete, date AS day, calories_burned AS energy FROM t"
)
ORACLE["round_modes"] = lines(
    """SELECT steps, count(*) AS num_records, round(steps / 2, 0) AS half_up, round_even(steps / 2, 0) AS half_even,
       round(steps / 4, 1) AS tenth_up, round_even(steps / 4, 1) AS tenth_even
FROM t GROUP BY steps"""
)

_TIERS = """SELECT user_id, strftime(date, '%Y-%m') AS month, avg(calories_burned / 5) AS a FROM t GROUP BY 1, 2"""
ORACLE["segment_tier_5"] = lines(
    f"""SELECT user_id, month, round(a, 6) AS avg_steps,
       CASE WHEN a < 5000 THEN 'Sedentary' WHEN a < 8000 THEN 'Lightly Active' WHEN a < 10000 THEN 'Active'
            WHEN a < 15000 THEN 'Very Active' ELSE 'Athlete' END AS tier
FROM ({_TIERS})"""
)
ORACLE["segment_tier_4"] = lines(
    f"""SELECT user_id, month, round(a, 6) AS avg_steps,
       CASE WHEN a < 5000 THEN 'Sedentary' WHEN a < 8000 THEN 'Lightly Active' WHEN a < 10000 THEN 'Active'
            ELSE 'High Performer' END AS tier
FROM ({_TIERS})"""
)
ORACLE["label_text"] = """
SELECT doc_id,
       array_to_string(list_transform(string_split(replace(lang || '_' || source, '_', ' '), ' '),
         lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label,
       substring(text, 1, 50) AS shown
FROM documents"""
ORACLE["format_text"] = lines(
    """SELECT activity_type, format('{:,}', count(*)) AS records,
       format('{:,.2f}', avg(calories_burned)) AS mean_calories,
       format('{:.2f}%', count(*) / (SELECT count(*) FROM t) * 100) AS share
FROM t GROUP BY activity_type"""
)

# Filters and quality

_EVENT_COLUMNS = (
    "event_id", "user_id", "date", "timestamp", "steps", "calories_burned",
    "heart_rate_avg", "sleep_hours", "activity_type",
)
_EVENT_SOURCE = {c: ("event_time" if c == "timestamp" else c) for c in _EVENT_COLUMNS}
ORACLE["null_counts"] = events(
    "\nUNION ALL\n".join(
        f'SELECT \'{c}\' AS "column", count(*) - count({s}) AS missing FROM t' for c, s in _EVENT_SOURCE.items()
    )
)
ORACLE["completeness_report"] = events(
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) - count({s}) AS missing,
       round_even(count({s}) / count(*) * 100, 2) AS complete_pct FROM t"""
        for c, s in {**_EVENT_SOURCE, "steps": "nullif(steps, 0)"}.items()
    )
)
_DUPLICATES = """SELECT CAST(sum(c) AS BIGINT) AS num_records, CAST(sum(c) - count(*) AS BIGINT) AS duplicates,
       round((sum(c) - count(*)) / sum(c) * 100, 4) AS duplicate_pct, count(*) AS unique_records"""
ORACLE["duplicate_report"] = events(
    f"{_DUPLICATES} FROM (SELECT count(*) AS c FROM t GROUP BY user_id, date, activity_type)"
)
ORACLE["duplicate_report_documents"] = (
    f"{_DUPLICATES} FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source)"
)
_LINE_TYPES = {
    "user_id": "bigint", "date": "date", "steps": "bigint", "calories_burned": "double",
    "heart_rate_avg": "bigint", "sleep_hours": "double", "activity_type": "string",
}
ORACLE["column_profile"] = lines(
    ", f AS (SELECT * FROM t ORDER BY user_id, date, steps, calories_burned, heart_rate_avg, sleep_hours, "
    "activity_type LIMIT 1)\n"
    + "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", '{d}' AS data_type, count(DISTINCT {c}) AS unique_values,
       (SELECT CAST({c} AS VARCHAR) FROM f) AS sample_value FROM t"""
        for c, d in _LINE_TYPES.items()
    )
)
_RULES = (
    ("steps", 0, 50000, "Steps should be between 0-50,000"),
    ("calories_burned", 0, 5000, "Calories should be between 0-5,000"),
    ("heart_rate_avg", 40, 220, "Heart rate should be between 40-220 bpm"),
    ("sleep_hours", 0, 24, "Sleep should be between 0-24 hours"),
)
ORACLE["validity_report"] = lines(
    "\nUNION ALL\n".join(
        f"""SELECT '{m}' AS metric, '{lo}-{hi}' AS expected_range,
       count(*) FILTER ({m} < {lo} OR {m} > {hi}) AS out_of_range,
       round((count(*) - count(*) FILTER ({m} < {lo} OR {m} > {hi})) / count(*) * 100, 4) AS valid_pct,
       '{rule}' AS description FROM t"""
        for m, lo, hi, rule in _RULES
    )
)
_BOUNDS = """(SELECT quantile_cont($m, 0.25) - 1.5 * (quantile_cont($m, 0.75) - quantile_cont($m, 0.25)) AS lo,
        quantile_cont($m, 0.75) + 1.5 * (quantile_cont($m, 0.75) - quantile_cont($m, 0.25)) AS hi FROM t)"""
ORACLE["outlier_report"] = events(
    "\nUNION ALL\n".join(
        f"""SELECT '{label}' AS metric, count(*) AS total_records,
       count(*) FILTER ($m < lo OR $m > hi) AS outliers,
       round(count(*) FILTER ($m < lo OR $m > hi) / count(*) * 100, 4) AS outlier_pct,
       round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound
FROM t, {_BOUNDS}""".replace("$m", m)
        for m, label in (("steps", "Steps"), ("calories_burned", "Calories Burned"))
    )
)
_SIDES = f"SELECT event_id, user_id, calories_burned FROM t, {_BOUNDS}".replace("$m", "calories_burned")
ORACLE["outlier_rows"] = events(f"{_SIDES} WHERE calories_burned < lo OR calories_burned > hi")
ORACLE["inlier_rows"] = events(f"{_SIDES} WHERE calories_burned >= lo AND calories_burned <= hi")
ORACLE["high_performer_share"] = lines(
    "SELECT round(count(*) FILTER (steps > 40) / count(*) * 100, 4) AS share_pct FROM t"
)

# Summaries

ORACLE["row_count"] = lines("SELECT count(*) AS num_records FROM t")
ORACLE["kpi_overview"] = lines(
    """SELECT count(*) AS num_records, count(DISTINCT user_id) AS num_users,
       count(DISTINCT activity_type) AS num_activities, round(avg(steps), 4) AS avg_steps,
       round(avg(calories_burned), 4) AS avg_calories, date_diff('day', min(date), max(date)) AS span_days
FROM t"""
)
ORACLE["kpi_statistics"] = lines(
    """SELECT count(*) AS num_records, count(DISTINCT user_id) AS num_users,
       round(avg(steps), 4) AS avg_steps, round(stddev_samp(steps), 4) AS std_steps,
       round(quantile_cont(steps, 0.5), 4) AS median_steps,
       round(avg(calories_burned), 4) AS avg_calories, round(stddev_samp(calories_burned), 4) AS std_calories,
       round(quantile_cont(calories_burned, 0.5), 4) AS median_calories,
       round(avg(heart_rate_avg), 4) AS avg_hr, round(stddev_samp(heart_rate_avg), 4) AS std_hr,
       round(avg(sleep_hours), 4) AS avg_sleep
FROM t"""
)
ORACLE["dataset_overview"] = lines(
    """SELECT count(*) AS num_records, count(DISTINCT user_id) AS num_users,
       min(date) AS first_date, max(date) AS last_date FROM t"""
)
ORACLE["monthly_summary"] = lines(
    f"""SELECT strftime(date, '%Y-%m') AS month, count(user_id) AS num_records,
       count(DISTINCT user_id) AS num_users, {ALL_MEANS}
FROM t GROUP BY 1"""
)
ORACLE["activity_summary_full"] = lines(
    f"""SELECT activity_type, count(user_id) AS num_records, count(DISTINCT user_id) AS num_users,
       {ALL_MEANS}, min(steps) AS min_steps, max(steps) AS max_steps
FROM t GROUP BY 1"""
)
ORACLE["activity_means"] = lines(f"SELECT activity_type, {ALL_MEANS} FROM t GROUP BY 1")
ORACLE["activity_stats"] = lines(
    "SELECT activity_type, round_even(avg(sleep_hours), 2) AS mean_sleep, "
    + ", ".join(
        f"""round_even(avg({m}), 2) AS mean_{n}, round_even(stddev_samp({m}), 2) AS std_{n},
       round_even(quantile_cont({m}, 0.5), 2) AS median_{n}"""
        for m, n in (("steps", "steps"), ("calories_burned", "calories"), ("heart_rate_avg", "hr"))
    )
    + " FROM t GROUP BY 1"
)
ORACLE["activity_ranked"] = lines(
    """SELECT activity_type, round_even(avg(steps), 0) AS avg_steps,
       round_even(avg(calories_burned), 0) AS avg_calories, round_even(avg(heart_rate_avg), 0) AS avg_hr,
       count(user_id) AS num_records
FROM t GROUP BY 1"""
)
ORACLE["hr_by_activity"] = lines("SELECT activity_type, round(avg(heart_rate_avg), 4) AS mean FROM t GROUP BY 1")
ORACLE["sleep_by_activity"] = lines("SELECT activity_type, round(avg(sleep_hours), 4) AS mean FROM t GROUP BY 1")
ORACLE["daily_trend"] = lines(
    """SELECT date, round(avg(steps), 6) AS avg_steps, round(avg(calories_burned), 6) AS avg_calories,
       round(avg(heart_rate_avg), 6) AS avg_hr FROM t GROUP BY 1"""
)
ORACLE["sql_most_active_day"] = events(
    f"SELECT {WEEKDAY} AS day_of_week, round(avg(steps), 4) AS average_steps FROM t GROUP BY 1"
)
ORACLE["dow_stats_calendar"] = events(
    f"""SELECT c.day_no, c.day_of_week, avg_steps, avg_calories, num_records
FROM (VALUES (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'), (6, 'Sat'), (7, 'Sun'))
     AS c(day_no, day_of_week)
LEFT JOIN (SELECT {WEEKDAY} AS day_of_week, round(avg(steps), 4) AS avg_steps,
                  round(avg(calories_burned), 4) AS avg_calories, count(user_id) AS num_records
           FROM t GROUP BY 1) s ON s.day_of_week = c.day_of_week"""
)
ORACLE["activity_counts"] = events("SELECT activity_type, count(*) AS num_records FROM t GROUP BY 1")
ORACLE["activity_share"] = events(
    """SELECT activity_type, count(*) AS num_records,
       round(count(*) / (SELECT count(*) FROM t) * 100, 4) AS share_pct FROM t GROUP BY 1"""
)
ORACLE["most_popular_activity"] = events(
    "SELECT activity_type, count(*) AS num_records FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
)
_PROFILE = """SELECT user_id, avg(steps) AS avg_steps, avg(calories_burned) AS avg_calories,
       avg(heart_rate_avg) AS avg_hr FROM t GROUP BY 1"""
ORACLE["user_profile"] = lines(
    f"""SELECT user_id, round(avg_steps, 6) AS avg_steps, round(avg_calories, 6) AS avg_calories,
       round(avg_hr, 6) AS avg_hr FROM ({_PROFILE})"""
)
_BASIC = """count($m) AS count, round(avg($m), 4) AS mean, round(stddev_samp($m), 4) AS std,
       CAST(min($m) AS DOUBLE) AS min, CAST(max($m) AS DOUBLE) AS max"""
ORACLE["describe_basic"] = lines(per_metric(f"SELECT '$m' AS metric, {_BASIC} FROM t"))
ORACLE["describe_quartiles"] = lines(
    per_metric(
        f"""SELECT '$m' AS metric, {_BASIC}, round(var_samp($m), 4) AS variance,
       round(quantile_cont($m, 0.25), 4) AS q1, round(quantile_cont($m, 0.5), 4) AS median,
       round(quantile_cont($m, 0.75), 4) AS q3 FROM t"""
    )
)
ORACLE["detailed_statistics"] = lines(
    per_metric(
        """SELECT '$m' AS metric, round_even(avg($m), 2) AS mean, round_even(stddev_samp($m), 2) AS std,
       CAST(min($m) AS DOUBLE) AS min, CAST(max($m) AS DOUBLE) AS max,
       round_even(skewness($m), 2) AS skewness, round_even(kurtosis($m), 2) AS kurtosis,
       round_even(quantile_cont($m, 0.25), 2) AS q1, round_even(quantile_cont($m, 0.5), 2) AS median,
       round_even(quantile_cont($m, 0.75), 2) AS q3,
       round_even(quantile_cont($m, 0.75) - quantile_cont($m, 0.25), 2) AS iqr FROM t"""
    )
)
ORACLE["correlation_matrix"] = lines(
    "\nUNION ALL\n".join(
        f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round(corr({a}, {b}), 6) AS corr FROM t"
        for a in METRICS
        for b in METRICS
    )
)
ORACLE["correlation_pairs"] = lines(
    """SELECT round(corr(steps, calories_burned), 6) AS steps_calories,
       round(corr(heart_rate_avg, calories_burned), 6) AS hr_calories FROM t"""
)
_EFFICIENCY = """SELECT activity_type, sum(calories_burned) / sum(steps) AS e FROM t GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 1"""
ORACLE["efficiency_best"] = lines(
    f"SELECT activity_type, round(e, 4) AS cal_per_step FROM ({_EFFICIENCY})"
)
ORACLE["efficiency_top5"] = lines(
    """SELECT activity_type, round_even(avg(calories_burned) / avg(steps), 3) AS calories_per_step
FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
)
ORACLE["key_findings"] = lines(
    f"""SELECT round(avg(steps), 4) AS avg_steps,
       round(count(*) FILTER (steps > 40) / count(*) * 100, 4) AS high_performer_pct,
       count(DISTINCT activity_type) AS num_activities, round(avg(heart_rate_avg), 4) AS avg_hr,
       min(heart_rate_avg) AS min_hr, max(heart_rate_avg) AS max_hr, round(avg(sleep_hours), 4) AS avg_sleep,
       round(corr(steps, calories_burned), 4) AS steps_calories_corr,
       round(corr(heart_rate_avg, calories_burned), 4) AS hr_calories_corr,
       CASE WHEN avg(sleep_hours) >= 7 THEN 'Good' ELSE 'Needs Improvement' END AS sleep_quality,
       (SELECT activity_type FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_popular_activity,
       (SELECT activity_type FROM ({_EFFICIENCY})) AS most_efficient_activity
FROM t"""
)
_RATINGS = "SELECT user_id, activity_type, count(*) AS rating FROM t GROUP BY 1, 2"
ORACLE["ratings"] = events(_RATINGS)
ORACLE["top3_activities_per_user"] = events(
    f"""SELECT * FROM (
  SELECT user_id, activity_type, rating,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, activity_type) AS INTEGER) AS rank
  FROM ({_RATINGS})) WHERE rank <= 3"""
)
ORACLE["label_lookup"] = events(
    f""", r AS ({_RATINGS}),
i AS (SELECT activity_type,
             CAST(row_number() OVER (ORDER BY count(*) DESC, activity_type) - 1 AS INTEGER) AS item_id
      FROM r GROUP BY 1)
SELECT item_id, user_id, rating, activity_type FROM r JOIN i USING (activity_type)"""
)

# Distributions


def _histogram(bins: int, value: str, source: str = "t") -> str:
    return f"""SELECT CAST(b AS BIGINT) AS bin, round(lo + (hi - lo) / {bins} * b, $d) AS bin_low,
       round(CASE WHEN b = {bins - 1} THEN hi ELSE lo + (hi - lo) / {bins} * (b + 1) END, $d) AS bin_high,
       coalesce(n, 0) AS num_records
FROM range({bins}) AS g(b)
CROSS JOIN (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {source})
LEFT JOIN (SELECT least(CAST(floor((CAST({value} AS DOUBLE) - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin,
                  count(*) AS n
           FROM {source}, (SELECT CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM {source})
           GROUP BY 1) c ON c.bin = g.b"""


ORACLE["histogram_steps"] = lines(_histogram(50, "steps").replace("$d", "4"))
ORACLE["histogram_hr"] = lines(_histogram(30, "heart_rate_avg").replace("$d", "4"))
ORACLE["histogram_sleep"] = lines(_histogram(20, "sleep_hours").replace("$d", "4"))
ORACLE["histogram_calories"] = events(_histogram(50, "calories_burned").replace("$d", "4"))


def _box(group: str) -> str:
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    using = f"JOIN q USING ({group})" if group else ", q"
    return events(
        f""", q AS (SELECT {key}min(calories_burned) AS low, quantile_cont(calories_burned, 0.25) AS q1,
     quantile_cont(calories_burned, 0.5) AS median, quantile_cont(calories_burned, 0.75) AS q3,
     max(calories_burned) AS high FROM t {by})
SELECT {key}round(any_value(low), 4) AS low, round(any_value(q1), 4) AS q1,
       round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3,
       round(any_value(high), 4) AS high,
       min(calories_burned) FILTER (calories_burned >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(calories_burned) FILTER (calories_burned <= q3 + 1.5 * (q3 - q1)) AS whisker_high
FROM t {using} {by}"""
    )


ORACLE["box_overall"] = _box("")
ORACLE["box_by_activity"] = _box("activity_type")
ORACLE["density_grid"] = events(
    """, s AS (SELECT count(*) AS n, min(calories_burned) AS lo, max(calories_burned) AS hi,
     1.059 * least(stddev_samp(calories_burned),
       (quantile_cont(calories_burned, 0.75) - quantile_cont(calories_burned, 0.25)) / 1.349)
     * pow(count(*), -0.2) AS bw FROM t),
g AS (SELECT s.*, unnest(range(CAST(ceil((hi - lo + 4 * bw) / (bw / 3)) AS BIGINT) + 1)) AS point,
             ceil((hi - lo + 4 * bw) / (bw / 3)) AS points FROM s),
x AS (SELECT *, lo - 2 * bw + point * ((hi - lo + 4 * bw) / points) AS x FROM g)
SELECT point, round(x, 6) AS x,
       round(sum(exp(-0.5 * pow((x - calories_burned) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) AS density
FROM x, t GROUP BY point, x"""
)
ORACLE["trend_by_activity"] = lines(
    """SELECT activity_type, count(*) AS num_points, round(regr_slope(calories_burned, steps), 4) AS slope,
       round(regr_intercept(calories_burned, steps), 4) AS intercept,
       round(regr_r2(calories_burned, steps), 4) AS r2
FROM t GROUP BY 1"""
)
ORACLE["scatter_sample"] = events(
    """SELECT event_id, activity_type, steps, calories_burned FROM (
  SELECT *, row_number() OVER (PARTITION BY activity_type ORDER BY md5('42|' || event_id), event_id) AS r FROM t
) WHERE r <= 50"""
)

# Order, limits, splits

ORACLE["latest_30"] = events(
    "SELECT event_id, user_id, event_time FROM t ORDER BY event_time DESC, event_id LIMIT 30"
)
ORACLE["split_hash_80_20"] = events(
    """SELECT event_id, CASE WHEN CAST('0x' || substr(md5('42|' || event_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.8
            THEN 'train' ELSE 'test' END AS side FROM t"""
)
ORACLE["sample_fixed_n"] = events(
    "SELECT event_id, steps, calories_burned FROM t ORDER BY md5('42|' || event_id), event_id LIMIT 2000"
)

# Segments on a rule

_SEGMENTS = f"""SELECT *, CASE WHEN avg_steps < 25 THEN 0 WHEN avg_steps < 25.5 THEN 1
     WHEN avg_steps < 26 THEN 2 ELSE 3 END AS prediction FROM ({_PROFILE})"""
ORACLE["cluster_profile"] = lines(
    f"""SELECT prediction, round(avg(avg_steps), 4) AS avg_steps, round(avg(avg_calories), 4) AS avg_calories,
       round(avg(avg_hr), 4) AS avg_hr, count(*) AS num_users FROM ({_SEGMENTS}) GROUP BY 1"""
)
ORACLE["cluster_sizes"] = lines(f"SELECT prediction, count(*) AS num_users FROM ({_SEGMENTS}) GROUP BY 1")
ORACLE["cluster_share"] = lines(
    f"""SELECT prediction, count(*) AS num_users,
       round(count(*) / (SELECT count(DISTINCT user_id) FROM t) * 100, 4) AS share_pct
FROM ({_SEGMENTS}) GROUP BY 1"""
)

# Windows

_WINDOW = "time_bucket(INTERVAL 30 SECONDS, event_time)"
_WINDOWS = f"""SELECT {_WINDOW} AS window_start, {_WINDOW} + INTERVAL 30 SECONDS AS window_end,
       activity_type, count(*) AS num_records FROM t GROUP BY 1, 2, 3"""
_CLOSED = f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(event_time) - INTERVAL 1 MINUTE FROM t)"
ORACLE["batch_window_counts"] = events(_WINDOWS)
ORACLE["stream_window_append"] = events(_CLOSED)
ORACLE["stream_window_latest"] = events(_CLOSED)
ORACLE["stream_file_source"] = events(
    """SELECT date, activity_type, count(*) AS num_records, CAST(sum(steps) AS BIGINT) AS sum_steps
FROM t GROUP BY 1, 2"""
)
ORACLE["stream_append_passthrough"] = events(
    """SELECT user_id, date_trunc('second', event_time) AS event_time, steps, calories_burned, activity_type
FROM t"""
)
ORACLE["stream_activity_breakdown"] = events(
    """SELECT activity_type, count(*) AS num_records, round(avg(steps), 2) AS avg_steps,
       round(avg(calories_burned), 2) AS avg_calories FROM t GROUP BY 1"""
)

# An event is dropped when its window was closed by the deliveries before its own.
_DELIVERED = f""", d AS (
  SELECT t.*, {_WINDOW} AS window_start, {_WINDOW} + INTERVAL 30 SECONDS AS window_end,
         least(1, CAST(floor((epoch_us(event_time) - lo) * 2 / (hi - lo)) AS INTEGER))
           + CASE WHEN activity_type = 'error' THEN 1 ELSE 0 END AS arrival
  FROM t, (SELECT min(epoch_us(event_time)) AS lo, max(epoch_us(event_time)) AS hi FROM t)),
m AS (SELECT a.arrival, max(d.event_time) AS newest
      FROM range(1, 3) AS a(arrival) JOIN d ON d.arrival < a.arrival GROUP BY 1),
k AS (SELECT d.* FROM d LEFT JOIN m USING (arrival)
      WHERE newest IS NULL OR window_end > newest - INTERVAL 1 MINUTE)"""
ORACLE["stream_window_update"] = events(
    f"""SELECT *, CAST(sum(num_records) OVER (
         PARTITION BY time_bucket(INTERVAL 1 HOUR, window_start), activity_type) AS BIGINT) AS hour_records
FROM ({_WINDOWS})"""
)
ORACLE["stream_late_data"] = events(
    f"""{_DELIVERED}
SELECT window_start, window_end, activity_type, count(*) AS num_records FROM k
WHERE window_end <= (SELECT max(event_time) - INTERVAL 1 MINUTE FROM t) GROUP BY 1, 2, 3"""
)

# A batch counts a window and activity once, however many of its late rows it drops.
ORACLE["stream_late_totals"] = events(
    f"""{_DELIVERED}
SELECT (SELECT count(*) FROM d) AS num_input_rows, count(DISTINCT (arrival, window_start, activity_type)) AS num_late_groups
FROM d JOIN m USING (arrival) WHERE window_end <= newest - INTERVAL 1 MINUTE"""
)

# Feature steps

ORACLE["feature_vector"] = lines(
    """SELECT user_id, date, CAST(steps AS DOUBLE) AS f0, calories_burned AS f1,
       CAST(heart_rate_avg AS DOUBLE) AS f2, sleep_hours AS f3 FROM t"""
)
ORACLE["string_index"] = events(
    """SELECT activity_type, CAST(row_number() OVER (ORDER BY count(*) DESC, activity_type) - 1 AS DOUBLE) AS idx,
       count(*) AS num_records FROM t GROUP BY activity_type"""
)


def _slots(where: str, slots: int) -> str:
    columns = ", ".join(
        f"CAST(sum(CASE WHEN r = {i} THEN 1 ELSE 0 END) AS DOUBLE) AS f{i}" for i in range(slots)
    )
    return lines(
        f""", i AS (SELECT activity_type, row_number() OVER (ORDER BY count(*) DESC, activity_type) - 1 AS r
      FROM t {where} GROUP BY 1)
SELECT t.activity_type, {columns} FROM t LEFT JOIN i USING (activity_type) GROUP BY 1"""
    )


ORACLE["one_hot"] = _slots("", 5)
ORACLE["one_hot_unseen"] = _slots("WHERE activity_type LIKE '%F'", 3)


def _scaled(expression: str, name: str) -> str:
    columns = ", ".join(
        f"round({expression.replace('$m', m)}, 4) AS {name.replace('$m', m).replace('$i', str(i))}"
        for i, m in enumerate(METRICS)
    )
    figures = ", ".join(
        f"avg({m}) AS {m}_avg, stddev_samp({m}) AS {m}_samp, stddev_pop({m}) AS {m}_pop" for m in METRICS
    )
    return lines(f"SELECT user_id, date, {columns} FROM t, (SELECT {figures} FROM t)")


ORACLE["standard_scale"] = _scaled("($m - $m_avg) / $m_samp", "f$i")
ORACLE["standard_scale_std_only"] = _scaled("$m / $m_samp", "$m_scaled")
ORACLE["standard_scale_pop"] = _scaled("($m - $m_avg) / $m_pop", "$m_scaled")
ORACLE["impute_median"] = events(
    """SELECT event_id, coalesce(CAST(nullif(steps, 0) AS DOUBLE),
       (SELECT quantile_cont(nullif(steps, 0), 0.5) FROM t)) AS steps FROM t"""
)
_FILLED = """SELECT activity_type, coalesce(CAST(nullif(steps, 1) AS DOUBLE),
       (SELECT quantile_cont(nullif(steps, 1), 0.5) FROM t)) AS x0,
     CAST(heart_rate_avg AS DOUBLE) AS x1, sleep_hours AS x2 FROM t"""
ORACLE["preprocess_regression"] = lines(
    f""", z AS ({_FILLED}),
s AS (SELECT avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1,
             stddev_pop(x2) AS s2 FROM z),
i AS (SELECT activity_type, row_number() OVER (ORDER BY count(*) DESC, activity_type) - 1 AS r FROM t GROUP BY 1)
SELECT activity_type, round((x0 - m0) / s0, 4) AS f0, round((x1 - m1) / s1, 4) AS f1,
       round((x2 - m2) / s2, 4) AS f2, """
    + ", ".join(f"CAST(CASE WHEN r = {k} THEN 1 ELSE 0 END AS DOUBLE) AS f{k + 3}" for k in range(6))
    + " FROM z JOIN i USING (activity_type) CROSS JOIN s"
)

# Scores with a known answer

# Every user gets as many activities as asked for.
# Least squares with an intercept for every activity: the slopes from the rows less their activity's means.
ORACLE["regress_linear"] = lines(
    """, d AS (SELECT activity_type AS c, calories_burned AS y, steps AS x, heart_rate_avg AS h, sleep_hours AS s,
     CAST('0x' || substr(md5('42|' || user_id || '|' || date || '|' || steps), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 AS train
   FROM t),
g AS (SELECT c, avg(y) AS my, avg(x) AS mx, avg(h) AS mh, avg(s) AS ms,
     count(*) * covar_pop(x, x) AS xx, count(*) * covar_pop(x, h) AS xh, count(*) * covar_pop(x, s) AS xs,
     count(*) * covar_pop(h, h) AS hh, count(*) * covar_pop(h, s) AS hs, count(*) * covar_pop(s, s) AS ss,
     count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(h, y) AS hy, count(*) * covar_pop(s, y) AS sy
   FROM d WHERE train GROUP BY c),
n AS (SELECT sum(xx) AS a, sum(xh) AS b, sum(xs) AS e, sum(hh) AS f, sum(hs) AS k, sum(ss) AS m,
     sum(xy) AS p, sum(hy) AS q, sum(sy) AS r FROM g),
w AS (SELECT a * (f * m - k * k) - b * (b * m - k * e) + e * (b * k - f * e) AS det,
     p * (f * m - k * k) - b * (q * m - k * r) + e * (q * k - f * r) AS dx,
     a * (q * m - k * r) - p * (b * m - k * e) + e * (b * r - q * e) AS dh,
     a * (f * r - q * k) - b * (b * r - q * e) + p * (b * k - f * e) AS ds FROM n),
o AS (SELECT y, my + dx / det * (x - mx) + dh / det * (h - mh) + ds / det * (s - ms) AS yhat
   FROM d JOIN g USING (c), w WHERE NOT train)
SELECT count(*) AS num_rows, round(sqrt(avg((y - yhat) * (y - yhat))), 4) AS rmse,
       round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 4) AS r2 FROM o"""
)
ORACLE["regress_linear_1d"] = lines(
    """SELECT steps, round(a + b * steps, 4) AS prediction, count(*) AS num_records
FROM t, (SELECT regr_intercept(calories_burned, steps) AS a, regr_slope(calories_burned, steps) AS b FROM t)
GROUP BY steps, a, b"""
)
_MEAN_SCORES = """SELECT activity_type, count(*) AS num_records, round(avg(calories_burned), 3) AS avg_prediction
FROM t GROUP BY 1"""
ORACLE["score_batch"] = lines(_MEAN_SCORES)
ORACLE["score_stream"] = lines(_MEAN_SCORES)
ORACLE["model_save_load_same_predictions"] = lines(
    "SELECT count(*) AS num_records, count(*) AS num_equal FROM t"
)

# Evaluation of a rule

_RULED = f"""WITH p AS (SELECT activity_type AS label,
     CASE WHEN steps <= 10 THEN 'AF' WHEN steps <= 20 THEN 'AO' WHEN steps <= 25 THEN 'NF'
          WHEN steps <= 35 THEN 'NO' WHEN steps <= 45 THEN 'RF' ELSE 'XX' END AS prediction
   FROM ({LINES}))
"""
ORACLE["metric_accuracy"] = _RULED + (
    "SELECT count(*) AS num_rows, round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy FROM p"
)
ORACLE["confusion_long"] = _RULED + "SELECT label, prediction, count(*) AS num_rows FROM p GROUP BY 1, 2"
ORACLE["confusion_grid"] = _RULED + """SELECT a.label, b.label AS prediction,
       (SELECT count(*) FROM p WHERE p.label = a.label AND p.prediction = b.label) AS num_rows
FROM (SELECT DISTINCT label FROM p) a CROSS JOIN (SELECT DISTINCT label FROM p) b"""
ORACLE["classification_report"] = _RULED + """, n AS (SELECT label AS name FROM p UNION SELECT prediction FROM p),
c AS (SELECT name, (SELECT count(*) FROM p WHERE label = name) AS support,
             (SELECT count(*) FROM p WHERE prediction = name) AS predicted,
             (SELECT count(*) FROM p WHERE label = name AND prediction = name) AS hits FROM n),
r AS (SELECT name, support, hits, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
             CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
      FROM r)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL
SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
       round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM f
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM f"""

_FIT = """, c AS (SELECT regr_intercept(calories_burned, steps) AS a, regr_slope(calories_burned, steps) AS b FROM t),
p AS (SELECT user_id, date, steps, calories_burned, a + b * steps AS prediction FROM t, c),
e AS (SELECT *, calories_burned - prediction AS residual FROM p)
"""
ORACLE["metric_rmse_r2"] = lines(
    _FIT
    + """SELECT count(*) AS num_rows, round(sqrt(avg(residual * residual)), 6) AS rmse,
       round(1 - avg(residual * residual) / var_pop(calories_burned), 6) AS r2 FROM e"""
)
ORACLE["residuals"] = lines(
    _FIT
    + """SELECT user_id, date, steps, round(calories_burned, 3) AS calories_burned,
       round(prediction, 3) AS prediction, round(residual, 3) AS residual FROM e"""
)
ORACLE["residual_histogram"] = lines(_FIT + _histogram(50, "residual", "e").replace("$d", "3"))
