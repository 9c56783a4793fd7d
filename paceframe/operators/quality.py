"""Data quality: completeness, duplicates, column profile, validity, outliers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.functions.columns import label_text, missing, percent, preview_text
from paceframe.operators.quantiles import ACCURACY, aggregate_with_quantiles, quantile_column
from paceframe.schemas import METRICS, VALID_RANGES, ValidRange
from paceframe.sources.readers import rows


def _rows(wide: DataFrame, structs: list[Column]) -> DataFrame:
    return wide.select(F.explode(F.array(*structs)).alias("row")).select("row.*")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column (null, or NaN), all columns in one pass."""
    wide = df.agg(
        *[F.count_if(missing(f.name, f.dataType)).alias(f.name) for f in df.schema.fields]
    )
    return _rows(
        wide,
        [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns],
    )


def completeness_report(df: DataFrame) -> DataFrame:
    """Missing values and percent complete (two decimals, half to even) per column."""
    wide = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(missing(f.name, f.dataType)).alias(f.name) for f in df.schema.fields],
    )
    return _rows(
        wide,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).alias("missing"),
                F.bround(percent(F.col("_n") - F.col(c), F.col("_n")), 2).alias("complete_pct"),
            )
            for c in df.columns
        ],
    )


def duplicate_report(df: DataFrame, digest: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first copy, their share, and the number of distinct rows.

    Copies are merged map-side, so a row that makes up a third of the table is no hot spot.
    Columns of long text named in ``digest`` are compared by their whole text's SHA-256, which
    keeps the shuffle narrow.
    """
    copies = df.withColumns({c: F.sha2(F.col(c), 256) for c in digest}) if digest else df
    copies = copies.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    total, unique = F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")
    return copies.agg(
        total.cast("bigint").alias("num_records"),
        (total - unique).cast("bigint").alias("duplicates"),
        percent(total - unique, total).alias("duplicate_pct"),
        unique.alias("unique_records"),
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, number of distinct values and a sample value per column.

    The distinct values of every column are counted by an aggregation of its own, which reads that
    column only: all of them together read the table once, and no row is repeated per column. The
    sample is taken from the first row in column order, so it does not depend on how the table is
    split.
    """
    first = df.agg(F.min(F.struct(*df.columns)).alias("first")).scalar()
    types = dict(df.dtypes)
    counts = {c: df.select(c).agg(F.count_distinct(c).alias("n")).scalar() for c in df.columns}
    one = rows(df.sparkSession, [(0,)], "_at int").withColumn("_first", first)
    return _rows(
        one,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c]).alias("data_type"),
                counts[c].alias("unique_values"),
                preview_text(F.col("_first")[c]).alias("sample_value"),
            )
            for c in df.columns
        ],
    )


def validity_report(df: DataFrame, rules: Iterable[ValidRange] = VALID_RANGES) -> DataFrame:
    """Values outside their accepted range per metric, in one pass."""
    rules = list(rules)
    wide = df.agg(
        F.count("*").alias("_n"),
        *[
            F.count_if((F.col(r.metric) < r.low) | (F.col(r.metric) > r.high)).alias(f"{r.metric}__bad")
            for r in rules
        ],
    )
    return _rows(
        wide,
        [
            F.struct(
                F.lit(r.metric).alias("metric"),
                F.lit(f"{r.low}-{r.high}").alias("expected_range"),
                F.col(f"{r.metric}__bad").alias("out_of_range"),
                percent(F.col("_n") - F.col(f"{r.metric}__bad"), F.col("_n")).alias("valid_pct"),
                F.lit(r.rule).alias("description"),
            )
            for r in rules
        ],
    )


def _iqr_bounds(metric: str) -> tuple[Column, Column]:
    q = F.col(quantile_column(metric))
    spread = q[1] - q[0]
    return q[0] - 1.5 * spread, q[1] + 1.5 * spread


def outlier_bounds(
    df: DataFrame, metrics: Sequence[str] = METRICS, accuracy: int = ACCURACY
) -> DataFrame:
    """One row with ``<metric>__low`` and ``<metric>__high``."""
    quartiles = aggregate_with_quantiles(df, metrics, (0.25, 0.75), accuracy=accuracy)
    return quartiles.select(
        *[
            bound.alias(f"{m}__{side}")
            for m in metrics
            for side, bound in zip(("low", "high"), _iqr_bounds(m))
        ]
    )


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    return df.withColumn("_b", one_row.select(F.struct(*one_row.columns).alias("b")).scalar())


def outlier_report(
    df: DataFrame, metrics: Sequence[str] = METRICS, accuracy: int = ACCURACY
) -> DataFrame:
    """Rows outside 1.5 IQR of the quartiles, per metric."""
    bounds = outlier_bounds(df, metrics, accuracy)
    counted = _attach(df.select(*metrics), bounds).agg(
        F.count("*").alias("_n"),
        F.any_value("_b").alias("_b"),
        *[
            F.count_if((F.col(m) < F.col(f"_b.{m}__low")) | (F.col(m) > F.col(f"_b.{m}__high"))).alias(m)
            for m in metrics
        ],
    )
    return _rows(
        counted,
        [
            F.struct(
                label_text(F.lit(m)).alias("metric"),
                F.col("_n").alias("total_records"),
                F.col(m).alias("outliers"),
                percent(F.col(m), F.col("_n")).alias("outlier_pct"),
                F.col(f"_b.{m}__low").alias("lower_bound"),
                F.col(f"_b.{m}__high").alias("upper_bound"),
            )
            for m in metrics
        ],
    )


def outlier_rows(df: DataFrame, metric: str, accuracy: int = ACCURACY) -> DataFrame:
    """Rows strictly outside the bounds of ``metric``."""
    bounded = _attach(df, outlier_bounds(df, (metric,), accuracy))
    v = F.col(metric)
    return bounded.where((v < F.col(f"_b.{metric}__low")) | (v > F.col(f"_b.{metric}__high"))).drop("_b")


def inlier_rows(df: DataFrame, metric: str, accuracy: int = ACCURACY) -> DataFrame:
    """Rows inside the bounds of ``metric``, ends included."""
    bounded = _attach(df, outlier_bounds(df, (metric,), accuracy))
    v = F.col(metric)
    return bounded.where((v >= F.col(f"_b.{metric}__low")) & (v <= F.col(f"_b.{metric}__high"))).drop("_b")
