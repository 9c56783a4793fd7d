import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paceframe.operators import metrics, models, preprocessing, recommend, segments, summaries
from paceframe.plans import train as train_plan
from paceframe.session import materialise
from paceframe.sources.readers import rows


@pytest.fixture(scope="module")
def telemetry(spark):
    """Activities with clearly different figures, so that models have something to learn."""
    rng = np.random.default_rng(3)
    base = {"walking": (6000, 300, 95), "running": (15000, 900, 150), "yoga": (1000, 200, 80)}
    parts = []
    for name, (steps, calories, rate) in base.items():
        n = 300
        parts.append(
            pd.DataFrame(
                {
                    "user_id": rng.integers(1, 60, n),
                    "activity_type": name,
                    "steps": rng.normal(steps, 300, n).astype(int),
                    "calories_burned": rng.normal(calories, 20, n),
                    "heart_rate_avg": rng.normal(rate, 4, n).astype(int),
                    "sleep_hours": rng.uniform(5, 9, n),
                }
            )
        )
    return spark.createDataFrame(pd.concat(parts)).persist()


def accuracy(scored):
    return metrics.accuracy(scored, "activity_type", "predicted").first()["accuracy"]


def test_classifiers_learn(telemetry):
    logistic = models.fit_logistic(telemetry).transform(telemetry)
    assert accuracy(logistic) > 0.95
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x)
    assert logistic.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9
    top = models.most_confident(logistic, 10, ("user_id",)).collect()
    assert len(top) == 10 and top[0]["confidence"] >= top[-1]["confidence"]
    size = models.ForestSize(5, 4, 1)
    forest = models.fit_forest_classifier(telemetry, size=size)
    assert accuracy(forest.transform(telemetry)) > 0.95
    importance = models.feature_importance(forest, models.CLASSIFIER_FEATURES, telemetry.sparkSession).collect()
    assert sum(r["importance"] for r in importance) == pytest.approx(1.0)
    assert importance[0]["importance"] >= importance[-1]["importance"]


def test_regressions_learn_and_accept_unseen_activities(telemetry):
    assert metrics.regression_metrics(models.fit_linear(telemetry).transform(telemetry), "calories_burned").first()["r2"] > 0.9
    forest = models.fit_forest_regressor(telemetry, size=models.ForestSize(5, 4, 1))
    assert metrics.regression_metrics(forest.transform(telemetry), "calories_burned").first()["r2"] > 0.9
    other = telemetry.limit(5).withColumn("activity_type", F.lit("HIIT"))
    assert forest.transform(other).where(F.col("prediction").isNotNull()).count() == 5


def test_median_and_population_scale_equal_the_definition(spark):
    values = [1.0, 2.0, 3.0, 4.0, None]
    df = rows(spark, [(v,) for v in values], "x double")
    assert sorted(r["x"] for r in preprocessing.impute_median(df, ("x",)).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    filled = np.array([1.0, 2.0, 3.0, 4.0, 2.5])
    scaled = preprocessing.fit_impute_scale(df, ("x",)).transform(df)
    expected = (filled - filled.mean()) / filled.std()
    assert sorted(r["x_scaled"] for r in scaled.collect()) == pytest.approx(sorted(expected))


def test_constant_columns_are_only_centred(spark):
    df = rows(spark, [(3,), (3,)], "x int")
    assert {r["x_scaled"] for r in preprocessing.fit_impute_scale(df, ("x",)).transform(df).collect()} == {0.0}
    assert {r["x_scaled"] for r in preprocessing.standardise(df, ("x",), population=True).collect()} == {0.0}


def test_missing_values_are_an_error_for_the_plain_assembler(spark):
    df = rows(spark, [(None,)], "x double")
    with pytest.raises(Exception):
        preprocessing.assembler(("x",)).transform(df).collect()


def test_unseen_category_is_all_zeros(spark):
    seen = rows(spark, [("a",), ("a",), ("b",)], "c string")
    stages = [preprocessing.string_indexer("c", "i", "keep"), preprocessing.one_hot("i", "v")]
    model = Pipeline(stages=stages).fit(seen)
    out = model.transform(rows(spark, [("a",), ("b",), ("z",)], "c string"))
    assert {r["c"]: r["v"].toArray().tolist() for r in out.collect()} == {"a": [1, 0], "b": [0, 1], "z": [0, 0]}


def test_segments_and_their_profile(telemetry):
    profiles = models.profiles_of(telemetry)
    model = models.fit_segments_restarts(profiles, k=3, restarts=3)
    out = models.segment_users(model, profiles)
    assert out.count() == profiles.count()
    assert out.select("prediction").distinct().count() == 3
    found = segments.cluster_tiers(out).collect()
    assert [r["avg_steps"] for r in found] == sorted(r["avg_steps"] for r in found)
    assert sum(r["num_users"] for r in found) == profiles.count()
    assert sum(r["share_pct"] for r in segments.cluster_shares(out).collect()) == pytest.approx(100.0)


def test_more_restarts_never_cost_more(telemetry):
    profiles = models.profiles_of(telemetry)
    vectors = preprocessing.assembler(models.PROFILE_FEATURES).transform(profiles).select("features").persist()
    one = models.best_kmeans(vectors, 4, [42]).summary.trainingCost
    many = models.best_kmeans(vectors, 4, range(42, 47)).summary.trainingCost
    assert many <= one


def test_cluster_quality(telemetry):
    found = models.cluster_quality(models.profiles_of(telemetry), (2, 3)).collect()
    assert [r["k"] for r in found] == [2, 3] and all(-1 <= r["silhouette"] <= 1 for r in found)


def test_all_sets_of_centres_are_scored_together(telemetry):
    profiles = models.profiles_of(telemetry)
    vectors = preprocessing.assembler(models.PROFILE_FEATURES).transform(profiles).select("features").persist()
    fits = {k: KMeans(k=k, seed=2).fit(vectors) for k in range(2, 9)}
    centres = {k: [list(map(float, c)) for c in m.clusterCenters()] for k, m in fits.items()}
    # A centre without rows, and a set with all rows in one cluster.
    centres[20] = [*centres[2], [1e9, 1e9, 1e9]]
    centres[30] = [centres[2][0], [1e9, 1e9, 1e9]]
    found = {r["k"]: r for r in models.score_centres(vectors, centres).collect()}
    for k, model in fits.items():
        assert found[k]["silhouette"] == pytest.approx(models.silhouette(model.transform(vectors)), abs=1e-9)
        points = np.array([r["features"].toArray() for r in vectors.collect()])
        squares = ((points[:, None, :] - np.array(centres[k])[None]) ** 2).sum(axis=2).min(axis=1)
        assert found[k]["cost"] == pytest.approx(squares.sum(), rel=1e-9)
    assert found[20]["silhouette"] == pytest.approx(found[2]["silhouette"], abs=1e-9) and found[30]["silhouette"] is None


def test_fits_do_not_depend_on_the_layout(telemetry, spark):
    profiles = models.profiles_of(telemetry)
    fits = []
    for parts in (1, 4, 8):
        with models.training_frame(profiles.repartition(parts), *models.PROFILE_FEATURES, rows_per_partition=20) as kept:
            assert kept.rdd.getNumPartitions() == -(-profiles.count() // 20)
        fits.append(models.fit_segments_scaled(profiles.repartition(parts)).stages[-1].clusterCenters())
    assert all(np.array_equal(fits[0], f) for f in fits[1:])


def test_stored_models_predict_the_same(telemetry, spark, tmp_path):
    model = models.fit_forest_regressor(telemetry, size=models.ForestSize(3, 3, 1))
    path = str(tmp_path / "m")
    models.save_model(model, path, ("steps", "activity_type"))
    a = [r["prediction"] for r in model.transform(telemetry).orderBy("calories_burned").collect()]
    b = [r["prediction"] for r in PipelineModel.load(path).transform(telemetry).orderBy("calories_burned").collect()]
    assert a == b
    assert models.load_features(spark, path) == ["steps", "activity_type"]


def test_training_job_stores_three_models(telemetry, spark, tmp_path):
    paths = train_plan.train_all(telemetry, str(tmp_path), models.ForestSize(2, 2, 1))
    segmenter = models.load_model(paths["user_segmentation"])
    profiles = models.profiles_of(telemetry)
    assert models.segment_users(segmenter, profiles).count() > 0
    stored = models.segment_users_stored(paths["user_segmentation"], profiles)
    absent = models.segment_users_stored(str(tmp_path / "absent"), profiles)
    assert stored.count() == profiles.count() and absent.count() == 0
    assert stored.dtypes == absent.dtypes
    assert models.load_features(spark, paths["user_segmentation"]) == list(models.PROFILE_FEATURES)


@pytest.mark.parametrize("offset", [0, 10_000_000_000])
def test_recommendations_for_any_user_ids(telemetry, offset):
    df = telemetry.withColumn("user_id", F.col("user_id") + offset)
    ratings = summaries.ratings(df)
    indexed = recommend.index_ratings(ratings)
    assert indexed.ratings.count() == ratings.count()
    model = recommend.fit_als(indexed.ratings)
    out = recommend.recommend(model, indexed, 2)
    per_user = out.groupBy("user_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect()
    assert len(per_user) == ratings.select("user_id").distinct().count()
    assert {(r["n"], r["r"]) for r in per_user} == {(2, 2)}
    assert {r["activity_type"] for r in out.collect()} <= {"walking", "running", "yoga"}
    assert out.agg(F.min("user_id")).first()[0] >= offset


def test_lists_hold_the_best_products(telemetry):
    model = recommend.fit_als(recommend.index_ratings(summaries.ratings(telemetry)).ratings)
    users, items = ({r["id"]: np.array(r["features"]) for r in f.collect()} for f in (model.userFactors, model.itemFactors))
    found = {r["user_no"]: r["recommendations"] for r in recommend.top_items(model, 2).collect()}
    assert set(found) == set(users)
    for user, best in found.items():
        scores = sorted((float(users[user] @ v) for v in items.values()), reverse=True)[:2]
        assert [b["rating"] for b in best] == pytest.approx(scores, rel=1e-4)
        assert [float(users[user] @ items[b["item_id"]]) for b in best] == pytest.approx(scores, rel=1e-4)


def test_equal_scores_are_ordered_by_item(spark):
    class Model:
        def recommendForAllUsers(self, k):
            item = "array<struct<item_id: int, rating: float>>"
            return spark.createDataFrame([(1, [(5, 2.0), (3, 2.0), (9, 4.0)]), (2, [])], f"user_no int, recommendations {item}")

    found = {r["user_no"]: [tuple(x) for x in r["recommendations"]] for r in recommend.top_items(Model(), 3).collect()}
    assert found == {1: [(9, 4.0), (3, 2.0), (5, 2.0)], 2: []}


def test_factors_of_every_user_solve_the_users_system(telemetry):
    ratings = recommend.index_ratings(summaries.ratings(telemetry)).ratings
    model = recommend.fit_als(ratings)
    found = recommend.user_residuals(model, ratings).collect()
    assert len(found) == ratings.select("user_no").distinct().count()
    assert max(r["residual"] for r in found) < 1e-3
    # Other ratings than those of the fit leave a gap.
    other = ratings.withColumn("rating", F.col("rating") * 3)
    assert max(r["residual"] for r in recommend.user_residuals(model, other).collect()) > 0.1


def test_the_logistic_fit_is_at_its_optimum(telemetry):
    model = models.fit_logistic(telemetry.withColumn("steps", F.col("steps") + 9000 * F.rand(1)))
    noisy = telemetry.withColumn("steps", F.col("steps") + 9000 * F.rand(1))
    at, away = models.logistic_gradient(model, noisy).first(), models.logistic_gradient(model, telemetry.limit(300)).first()
    assert at["num_rows"] == 900 and at["max_gradient"] < 1e-4 < away["max_gradient"]


@pytest.mark.parametrize("classify", [True, False])
def test_full_size_forests_in_groups(telemetry, tmp_path, classify):
    """A hundred trees of the full depth, ten at a time, each group on a sample of its own."""
    groups = models.fit_forest_groups(telemetry, str(tmp_path), classify, group_rows=600)
    assert groups == 10 and len(list(tmp_path.glob("group=*"))) == 10
    scored = models.score_forest_groups(telemetry, str(tmp_path), groups, classify)
    assert set(telemetry.columns) <= set(scored.columns) and scored.count() == telemetry.count()
    if classify:
        assert accuracy(scored) > 0.97
        total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
        assert scored.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9
    else:
        assert metrics.regression_metrics(scored, "calories_burned").first()["r2"] > 0.97


def test_groups_average_to_one_forest(telemetry, tmp_path):
    size = models.ForestSize(6, 5, 2)
    parts = models.fit_forest_groups(telemetry, str(tmp_path), False, size, group_trees=4)
    scored = models.score_forest_groups(telemetry, str(tmp_path), parts, False)
    prepare = PipelineModel.load(f"{tmp_path}/prepare")
    means = np.zeros(telemetry.count())
    for g, trees in enumerate((4, 2)):
        forest = models.RandomForestRegressionModel.load(f"{tmp_path}/group={g}")
        out = forest.transform(prepare.transform(telemetry)).orderBy("calories_burned")
        means += trees * np.array([r["prediction"] for r in out.select("prediction").collect()])
    found = [r["prediction"] for r in scored.orderBy("calories_burned").collect()]
    assert found == pytest.approx(list(means / 6))


def test_dense_ids_are_consecutive(spark):
    df = spark.range(100).select((F.col("id") * 10**10).alias("u")).union(spark.range(5).select("id"))
    ids = sorted(r["n"] for r in recommend.dense_ids(df, "u", "n").collect())
    assert ids == list(range(104))


@pytest.mark.parametrize("classify", [True, False])
def test_merged_forests_are_as_good_as_those_grown_row_by_row(telemetry, spark, tmp_path, classify):
    fit = models.fit_forest_classifier if classify else models.fit_forest_regressor
    size = models.ForestSize(8, 5, 3)
    merged, single = (fit(telemetry, size=size, merge_above=m) for m in (0, 10**9))
    forest = next(s for s in merged.stages if hasattr(s, "getNumTrees"))
    assert forest.getNumTrees == 8 and forest.totalNumNodes > 8
    scored, reference = merged.transform(telemetry), single.transform(telemetry)
    if classify:
        assert accuracy(scored) > accuracy(reference) - 0.02
        importance = [dict(map(tuple, models.feature_importance(m, models.CLASSIFIER_FEATURES, spark).collect())) for m in (merged, single)]
        assert sum(importance[0].values()) == pytest.approx(1.0)
    else:
        found, wanted = (metrics.regression_metrics(s, "calories_burned").first()["r2"] for s in (scored, reference))
        assert found > wanted - 0.02
    again = fit(telemetry.repartition(5), size=size, merge_above=0).transform(telemetry)
    path = str(tmp_path / "m")
    models.save_model(merged, path)
    for other in (again, PipelineModel.load(path).transform(telemetry)):
        both = [sorted(r[0] for r in s.select("prediction").collect()) for s in (scored, other)]
        assert both[0] == pytest.approx(both[1])


def test_merged_forests_read_their_rows_once_a_group(spark, monkeypatch):
    df = rows(spark, [(i % 7, float(i % 5), i % 3, "ab"[i % 2]) for i in range(3000)], "steps int, calories_burned double, heart_rate_avg int, activity_type string")
    sizes = []
    monkeypatch.setattr(models, "materialise", lambda merged, name: sizes.append(merged.count()) or materialise(merged, name))
    models.fit_forest_classifier(df, size=models.ForestSize(12, 3, 1), merge_above=1000)
    assert sizes == [210, 210]
