"""Named queries for feature steps, models, scoring and evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.operators import metrics, models, preprocessing, recommend, sampling, segments, summaries
from paceframe.plans.registry import Registry, rounded
from paceframe.schemas import METRICS
from paceframe.session import materialise, scratch_path
from paceframe.sources.readers import rows
from paceframe.sources.adapters import event_telemetry, line_telemetry

QUERIES = Registry()

# Mean steps of the line telemetry lie between 22 and 29.
LINE_TIERS = ((24.0, "Low"), (26.0, "Middle"), (None, "High"))

ROW_KEY = ("user_id", "date", *METRICS, "activity_type")


def _split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    train, test = sampling.hash_split(line_telemetry(spark, sf), ROW_KEY)
    return train, test


def _spread(df: DataFrame, vector: str, size: int, prefix: str = "f") -> DataFrame:
    """A vector column as ``size`` plain columns."""
    values = df.withColumn("_v", vector_to_array(vector))
    return values.withColumns({f"{prefix}{i}": F.col("_v")[i] for i in range(size)}).drop("_v", vector)


# Feature steps


@QUERIES.add
def feature_vector(spark, sf):
    lines = line_telemetry(spark, sf)
    vectors = preprocessing.assembler(METRICS).transform(lines)
    return _spread(vectors.select("user_id", "date", "features"), "features", 4)


@QUERIES.add
def string_index(spark, sf):
    events = event_telemetry(spark, sf).select("activity_type")
    indexed = preprocessing.string_indexer("activity_type", "idx").fit(events).transform(events)
    return indexed.groupBy("activity_type", "idx").agg(F.count("*").alias("num_records"))


def _one_hot_totals(fit_on: DataFrame, rows: DataFrame, unseen: str, slots: int) -> DataFrame:
    stages = [
        preprocessing.string_indexer("activity_type", "idx", unseen),
        preprocessing.one_hot("idx", "vec"),
    ]
    encoded = Pipeline(stages=stages).fit(fit_on).transform(rows)
    spread = _spread(encoded.select("activity_type", "vec"), "vec", slots)
    return spread.groupBy("activity_type").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(slots)])


@QUERIES.add
def one_hot(spark, sf):
    """Rows per slot: every value has a slot of its own but the rarest one."""
    lines = line_telemetry(spark, sf).select("activity_type")
    return _one_hot_totals(lines, lines, "error", 5)


@QUERIES.add
def one_hot_unseen(spark, sf):
    """Fitted on three of six values; the others give all zeros."""
    lines = line_telemetry(spark, sf).select("activity_type")
    return _one_hot_totals(lines.where(F.col("activity_type").endswith("F")), lines, "keep", 3)


@QUERIES.add
def standard_scale(spark, sf):
    lines = line_telemetry(spark, sf)
    stages = [
        preprocessing.assembler(METRICS, "raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]
    scaled = Pipeline(stages=stages).fit(lines).transform(lines)
    return rounded(_spread(scaled.select("user_id", "date", "features"), "features", 4))


@QUERIES.add
def standard_scale_std_only(spark, sf):
    lines = line_telemetry(spark, sf).select("user_id", "date", *METRICS)
    scaled = preprocessing.standardise(lines, METRICS, with_mean=False)
    return rounded(scaled.drop(*METRICS))


@QUERIES.add
def standard_scale_pop(spark, sf):
    lines = line_telemetry(spark, sf).select("user_id", "date", *METRICS)
    return rounded(preprocessing.standardise(lines, METRICS, population=True).drop(*METRICS))


@QUERIES.add
def impute_median(spark, sf):
    """Zero steps count as not recorded and become the median of the others."""
    events = event_telemetry(spark, sf).select("event_id", F.nullif("steps", F.lit(0)).alias("steps"))
    return preprocessing.impute_median(events, ("steps",))


@QUERIES.add
def preprocess_regression(spark, sf):
    lines = line_telemetry(spark, sf).withColumn("steps", F.nullif("steps", F.lit(1)))
    stages = models.regression_preprocessing(lines, models.REGRESSOR_FEATURES, "activity_type")
    ready = Pipeline(stages=stages).fit(lines).transform(lines)
    return rounded(_spread(ready.select("activity_type", "features"), "features", 9))


# Models


@QUERIES.add
def classify_logistic(spark, sf):
    """Confusion on held-out rows of the logistic classifier."""
    train, test = _split(spark, sf)
    scored = models.fit_logistic(train).transform(test)
    return metrics.confusion_long(scored, "activity_type", "predicted")


@QUERIES.add
def logistic_optimality(spark, sf):
    """How far the logistic fit is from the optimum: the largest gradient of its loss over all rows."""
    train, _ = _split(spark, sf)
    return models.logistic_gradient(models.fit_logistic(train), train)


@QUERIES.add
def classify_forest_light(spark, sf):
    train, test = _split(spark, sf)
    scored = models.fit_forest_classifier(train).transform(test)
    return metrics.classification_report(scored, "activity_type", "predicted")


@QUERIES.add
def top10_confident(spark, sf):
    train, test = _split(spark, sf)
    scored = models.fit_logistic(train).transform(test)
    return models.most_confident(scored, 10, ROW_KEY).select(
        "activity_type", "predicted", "confidence"
    )


@QUERIES.add
def regress_linear(spark, sf):
    # Split by a digest that SQL can reproduce.
    train, test = sampling.hash_split(line_telemetry(spark, sf), ("user_id", "date", "steps"), portable=True)
    return rounded(metrics.regression_metrics(models.fit_linear(train).transform(test), "calories_burned"))


@QUERIES.add
def regress_linear_1d(spark, sf):
    lines = line_telemetry(spark, sf)
    fitted = models.fit_linear(lines, ("steps",), None).stages[-1]
    # The two coefficients are applied to the table, so the result is a figure of all rows.
    predicted = lines.withColumn("prediction", fitted.intercept + fitted.coefficients[0] * F.col("steps"))
    return rounded(
        predicted.groupBy("steps").agg(F.avg("prediction").alias("prediction"), F.count("*").alias("num_records"))
    )


@QUERIES.add
def regress_forest_light(spark, sf):
    train, test = _split(spark, sf)
    scored = models.fit_forest_regressor(train).transform(test)
    return metrics.regression_metrics(scored, "calories_burned")


@QUERIES.add
def feature_importance(spark, sf):
    fitted = models.fit_forest_classifier(line_telemetry(spark, sf))
    return models.feature_importance(fitted, models.CLASSIFIER_FEATURES, spark)


@QUERIES.add
def segment_users_k3(spark, sf):
    profiles = models.profiles_of(line_telemetry(spark, sf))
    return models.segment_users(models.fit_segments_scaled(profiles), profiles)


@QUERIES.add
def segment_users_k5(spark, sf):
    profiles = models.profiles_of(line_telemetry(spark, sf))
    return models.segment_users(models.fit_segments_restarts(profiles), profiles)


@QUERIES.add
def segment_score(spark, sf):
    """Users assigned with a stored model."""
    profiles = models.profiles_of(line_telemetry(spark, sf))
    path = scratch_path(spark, "user_segmentation")
    models.save_model(models.fit_segments_scaled(profiles), path, models.PROFILE_FEATURES)
    return models.segment_users_stored(path, profiles)


@QUERIES.add
def kmeans_elbow(spark, sf):
    return models.cluster_quality(models.profiles_of(line_telemetry(spark, sf)))


@QUERIES.add
def segment_report(spark, sf):
    """Users, shares, profiles and tiers of the clusters of a fitted segmentation."""
    profiles = models.profiles_of(line_telemetry(spark, sf))
    assigned = materialise(models.segment_users(models.fit_segments_scaled(profiles), profiles), "segments")
    shares = segments.cluster_shares(assigned).select("prediction", "share_pct")
    return segments.cluster_tiers(assigned, LINE_TIERS).join(shares, "prediction")


@QUERIES.add
def model_comparison(spark, sf):
    """The headline score of each model, the forests' on held-out rows and the segments' on all users."""
    train, test = _split(spark, sf)
    profiles = models.profiles_of(line_telemetry(spark, sf))
    score = models.silhouette(models.fit_segments_scaled(profiles, k=5).transform(profiles))
    classified = models.fit_forest_classifier(train).transform(test)
    regressed = models.fit_forest_regressor(train).transform(test)
    segmentation = rows(
        spark,
        [("User Segmentation", "K-Means", "Silhouette Score", score)],
        "model string, algorithm string, metric string, score double",
    )

    def row(figures: DataFrame, model: str, metric: str, column: str) -> DataFrame:
        return figures.select(
            F.lit(model).alias("model"),
            F.lit("Random Forest").alias("algorithm"),
            F.lit(metric).alias("metric"),
            F.col(column).alias("score"),
        )

    accuracy = metrics.accuracy(classified, "activity_type", "predicted")
    errors = metrics.regression_metrics(regressed, "calories_burned")
    return segmentation.unionByName(row(accuracy, "Activity Classification", "Accuracy", "accuracy")).unionByName(
        row(errors, "Calorie Regression", "R² Score", "r2")
    )


@QUERIES.add
def score_batch(spark, sf):
    """Mean prediction per activity; least squares with an activity term reproduces the means."""
    lines = line_telemetry(spark, sf)
    scored = models.fit_linear(lines).transform(lines)
    return rounded(
        scored.groupBy("activity_type").agg(
            F.count("*").alias("num_records"), F.avg("prediction").alias("avg_prediction")
        ),
        3,
    )


@QUERIES.add
def model_save_load_same_predictions(spark, sf):
    lines = line_telemetry(spark, sf)
    fitted = models.fit_linear(lines)
    path = scratch_path(spark, "calories_linear")
    models.save_model(fitted, path, (*models.REGRESSOR_FEATURES, "activity_type"))
    stored = PipelineModel.load(path)
    # Both pipelines score the same rows: the second sees the first one's output renamed.
    made = ("activity_idx", "activity_vec", "features")
    first = fitted.transform(lines).drop(*made).withColumnRenamed("prediction", "fitted_prediction")
    return stored.transform(first).agg(
        F.count("*").alias("num_records"),
        F.count_if(F.col("prediction") == F.col("fitted_prediction")).alias("num_equal"),
    )


# Recommendations


@QUERIES.add
def als_predict(spark, sf):
    """Error of the factorisation on held-out ratings, and how far any user's factors are from the
    solution of the user's own least-squares system."""
    indexed = recommend.index_ratings(summaries.ratings(event_telemetry(spark, sf)))
    train, test = sampling.hash_split(indexed.ratings, ("user_id", "activity_type"))
    model = recommend.fit_als(train)
    figures = metrics.regression_metrics(model.transform(test).withColumn("rating", F.col("rating").cast("double")), "rating")
    residual = recommend.user_residuals(model, train).agg(F.max("residual").alias("r"))
    return figures.withColumn("max_residual", residual.scalar())


@QUERIES.add
def recommend_top3(spark, sf):
    """The nested lists with item numbers and scores, a row an item."""
    indexed = recommend.index_ratings(summaries.ratings(event_telemetry(spark, sf)))
    lists = recommend.top_items(recommend.fit_als(indexed.ratings), 3)
    return lists.select("user_no", F.posexplode("recommendations").alias("at", "r")).select(
        "user_no", (F.col("at") + 1).alias("rank"), "r.item_id", "r.rating"
    )


@QUERIES.add
def recommendations_named(spark, sf):
    indexed = recommend.index_ratings(summaries.ratings(event_telemetry(spark, sf)))
    return recommend.recommend(recommend.fit_als(indexed.ratings), indexed, 3)


# Evaluation of a rule in place of a fitted model


def _ruled_labels(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.col("steps")
    rule = (
        F.when(steps <= 10, "AF").when(steps <= 20, "AO").when(steps <= 25, "NF").when(steps <= 35, "NO")
    )
    return line_telemetry(spark, sf).select(
        F.col("activity_type").alias("label"), rule.when(steps <= 45, "RF").otherwise("XX").alias("prediction")
    )


@QUERIES.add
def metric_accuracy(spark, sf):
    return rounded(metrics.accuracy(_ruled_labels(spark, sf)), 6)


@QUERIES.add
def confusion_long(spark, sf):
    return metrics.confusion_long(_ruled_labels(spark, sf))


@QUERIES.add
def confusion_grid(spark, sf):
    return metrics.confusion_grid(_ruled_labels(spark, sf))


@QUERIES.add
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_ruled_labels(spark, sf)), 6)


def _line_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Calories predicted from steps by the least-squares line of the same rows."""
    lines = line_telemetry(spark, sf)
    fit = lines.agg(
        F.struct(
            F.regr_slope("calories_burned", "steps").alias("slope"),
            F.regr_intercept("calories_burned", "steps").alias("intercept"),
        ).alias("line")
    )
    predicted = lines.withColumn("_line", fit.scalar()).withColumn(
        "prediction", F.col("_line.intercept") + F.col("_line.slope") * F.col("steps")
    )
    return predicted.select("user_id", "date", "steps", "calories_burned", "prediction")


@QUERIES.add
def metric_rmse_r2(spark, sf):
    return rounded(metrics.regression_metrics(_line_fit(spark, sf), "calories_burned"), 6)


@QUERIES.add
def residuals(spark, sf):
    return rounded(metrics.residuals(_line_fit(spark, sf), "calories_burned"), 3)


@QUERIES.add
def residual_histogram(spark, sf):
    return rounded(metrics.residual_histogram(_line_fit(spark, sf), "calories_burned"), 3)
