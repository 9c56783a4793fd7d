"""Feature preparation with exact medians and population scaling, as storable ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceframe.operators.quantiles import ACCURACY, aggregate_with_quantiles, quantile_column


def impute_median(
    df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY
) -> DataFrame:
    """Missing values become the exact median of their column."""
    medians = aggregate_with_quantiles(df, columns, (0.5,), accuracy=accuracy).select(
        F.struct(*[F.col(quantile_column(c))[0].alias(c) for c in columns]).alias("m")
    )
    filled = df.withColumn("_m", medians.scalar())
    return filled.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col("_m")[c]) for c in columns}
    ).drop("_m")


def standardise(df: DataFrame, columns: Sequence[str], with_mean: bool = True, population: bool = False) -> DataFrame:
    """Scaled copies ``<column>_scaled``: sample or population deviation, centred or not."""
    deviation = F.stddev_pop if population else F.stddev_samp
    figures = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}__mean") for c in columns],
            *[deviation(c).alias(f"{c}__std") for c in columns],
        ).alias("s")
    )
    scaled = df.withColumn("_s", figures.scalar())

    def value(c: str):
        centred = F.col(c) - F.col(f"_s.{c}__mean") if with_mean else F.col(c)
        std = F.col(f"_s.{c}__std")
        return F.when(std > 0, centred / std).otherwise(centred if population else F.lit(0.0))

    return scaled.withColumns({f"{c}_scaled": value(c) for c in columns}).drop("_s")


def fit_impute_scale(
    df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY
) -> SQLTransformer:
    """Median imputation followed by population scaling, fitted into one SQL stage.

    The figures after imputation follow from those before it and the number of gaps, so one
    aggregation is enough. The stage stores with any pipeline and also works on streams.
    """
    aggs = [F.count("*").alias("_n")]
    for c in columns:
        aggs += [
            F.count(c).alias(f"{c}__n"),
            F.avg(c).alias(f"{c}__mean"),
            F.var_pop(c).alias(f"{c}__var"),
        ]
    row = aggregate_with_quantiles(df, columns, (0.5,), (), aggs, accuracy).first()
    terms = []
    for c in columns:
        known, gaps = row[f"{c}__n"], row["_n"] - row[f"{c}__n"]
        if not known:
            raise ValueError(f"column {c} has no values")
        median, mean, var = row[quantile_column(c)][0], row[f"{c}__mean"], row[f"{c}__var"]
        filled_mean = (known * mean + gaps * median) / row["_n"]
        filled_var = (
            known * (var + (mean - filled_mean) ** 2) + gaps * (median - filled_mean) ** 2
        ) / row["_n"]
        scale = filled_var**0.5 or 1.0
        terms.append(
            f"(coalesce(CAST({c} AS DOUBLE), CAST({median!r} AS DOUBLE)) - CAST({filled_mean!r} AS DOUBLE))"
            f" / CAST({scale!r} AS DOUBLE) AS {c}_scaled"
        )
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def string_indexer(column: str, output: str, unseen: str = "error") -> StringIndexer:
    """Index by falling frequency, equal counts by name."""
    return StringIndexer(
        inputCol=column, outputCol=output, stringOrderType="frequencyDesc", handleInvalid=unseen
    )


def one_hot(index: str, output: str) -> OneHotEncoder:
    """One slot per index but the last.

    With an indexer that keeps unseen values the last index is the one for those, so every
    known value has a slot and an unseen one is all zeros.
    """
    return OneHotEncoder(inputCol=index, outputCol=output, dropLast=True)


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    """Columns to one vector; a missing value is an error."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error")
