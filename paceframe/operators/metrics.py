"""Evaluation of predictions, from frames that hold actual and predicted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceframe.operators.distributions import histogram


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)
    return df.agg(F.count("*").alias("num_rows"), F.avg(hit).alias("accuracy"))


def confusion_long(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per observed (label, prediction) pair."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("num_rows")
    )


def confusion_grid(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The full matrix over the actual labels, zeros included.

    The grid is spanned from the set of labels, as large as there are classes.
    """
    pairs = confusion_long(df, label, prediction)
    labels = pairs.agg(F.array_sort(F.collect_set("label")).alias("labels")).scalar()
    rows = pairs.select("label").where(F.col("label").isNotNull()).distinct()
    grid = rows.withColumn("prediction", F.explode(labels))
    return grid.join(pairs, ["label", "prediction"], "left").select(
        "label", "prediction", F.coalesce("num_rows", F.lit(0)).cast("bigint").alias("num_rows")
    )


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def per_class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    pairs = confusion_long(df, label, prediction)
    hits = F.when(F.col("label") == F.col("prediction"), F.col("num_rows")).otherwise(0)
    # Each pair counts once for its label and once for its prediction.
    sides = pairs.select(
        hits.alias("hits"),
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("name"), F.col("num_rows").alias("actual"), F.lit(0).cast("bigint").alias("predicted")
                ),
                F.struct(
                    F.col("prediction").alias("name"), F.lit(0).cast("bigint").alias("actual"), F.col("num_rows").alias("predicted")
                ),
            )
        ).alias("side"),
    )
    # A hit appears on both sides, hence the half.
    totals = sides.groupBy(F.col("side.name").alias("name")).agg(
        (F.sum("hits") / 2).alias("hits"),
        F.sum("side.actual").alias("support"),
        F.sum("side.predicted").alias("predicted"),
    )
    precision = _safe(F.col("hits"), F.col("predicted"))
    recall = _safe(F.col("hits"), F.col("support"))
    return (
        totals.withColumns({"precision": precision, "recall": recall})
        .withColumn(
            "f1",
            _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
        .select("name", "precision", "recall", "f1", "support", "hits")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class, then accuracy, macro mean and support-weighted mean."""
    classes = per_class_report(df, label, prediction)
    support = F.sum("support")
    measures = ("precision", "recall", "f1")
    hit_rate = F.sum("hits") / support
    overall = classes.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("name"),
                *[hit_rate.alias(m) for m in measures],
                support.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("name"),
                *[F.avg(m).alias(m) for m in measures],
                support.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("name"),
                *[(F.sum(F.col(m) * F.col("support")) / support).alias(m) for m in measures],
                support.alias("support"),
            ),
        ).alias("rows")
    )
    return classes.drop("hits").unionByName(
        overall.select(F.explode("rows").alias("row")).select("row.*")
    )


def regression_metrics(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """RMSE and R², from one pass."""
    error = F.col(label) - F.col(prediction)
    return df.agg(
        F.count("*").alias("num_rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.var_pop(label) > 0, 1 - F.avg(error * error) / F.nullif(F.var_pop(label), F.lit(0.0))).alias("r2"),
    )


def residuals(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """The scored rows with residual = actual − predicted."""
    return df.withColumn("residual", F.col(label) - F.col(prediction))


def residual_histogram(df: DataFrame, label: str, prediction: str = "prediction", bins: int = 50) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)
