"""Training, scoring and storing of the segmentation, classification and regression models."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import SparkContext, StorageLevel, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Bucketizer, IndexToString, OneHotEncoderModel, SQLTransformer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.functions.columns import hash_unit
from paceframe.operators.preprocessing import assembler, fit_impute_scale, one_hot, string_indexer
from paceframe.operators.summaries import user_profile
from paceframe.session import materialise
from paceframe.sources.readers import rows as literal_rows

CLASSIFIER_FEATURES = ("steps", "calories_burned", "heart_rate_avg")
LOGISTIC_FEATURES = ("steps", "calories_burned", "heart_rate_avg", "sleep_hours")
REGRESSOR_FEATURES = ("steps", "heart_rate_avg", "sleep_hours")
PROFILE_FEATURES = ("avg_steps", "avg_calories", "avg_hr")
SEGMENTS = "user_id bigint, avg_steps double, avg_calories double, avg_hr double, prediction int"


class ForestSize(NamedTuple):
    trees: int
    depth: int
    leaf: int


# The two published sizes. Spark limits the depth of a tree to 30.
LIGHT = ForestSize(trees=30, depth=12, leaf=10)
FULL = ForestSize(trees=100, depth=30, leaf=1)


# The logistic fit goes on until its loss hardly falls, so that its gradient is close to zero.
LOGISTIC_STEPS, LOGISTIC_TOLERANCE = 500, 1e-8

# Fits depend on how rows are dealt out, so that follows from the number of rows and not from the cluster.
ROWS_PER_PARTITION = 100_000


@contextmanager
def training_frame(df: DataFrame, *columns: str, rows_per_partition: int = ROWS_PER_PARTITION) -> Iterator[DataFrame]:
    """The needed columns, kept while an iterative fit runs over them.

    Rows are dealt out by their values to as many partitions as their number asks for and sorted
    there, so that the same rows give the same fit whatever files and cores there are. Spilled to
    disk when memory is short, and recomputed for a lost executor.
    """
    chosen = df.select(*columns)
    partitions = max(1, -(-chosen.count() // rows_per_partition))
    vectors = [c for c, kind in chosen.dtypes if kind == "vector"]
    keys = [F.to_json(vector_to_array(c)) if c in vectors else F.col(c) for c in columns]
    dealt = chosen.repartition(partitions, *keys).sortWithinPartitions(*keys)
    kept = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def fit_logistic(
    df: DataFrame, features: Sequence[str] = LOGISTIC_FEATURES, label: str = "activity_type"
) -> PipelineModel:
    """Multinomial logistic regression on features divided by their sample deviation."""
    stages = [
        string_indexer(label, "label"),
        assembler(features, "features_unscaled"),
        StandardScaler(inputCol="features_unscaled", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=LOGISTIC_STEPS, tol=LOGISTIC_TOLERANCE),
    ]
    with training_frame(df, *features, label) as rows:
        return _with_label_names(Pipeline(stages=stages).fit(rows))


def logistic_gradient(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(num_rows, max_gradient): the largest partial derivative of the mean loss of a logistic fit by a
    coefficient or an intercept, over all rows of ``df`` and on the fit's own scale. It is 0 at the optimum."""
    fitted = next(s for s in model.stages if hasattr(s, "coefficientMatrix"))
    classes, size = fitted.numClasses, fitted.numFeatures
    scored = model.transform(df).select(
        vector_to_array("probability").alias("p"), vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y")
    )
    parts = []
    for k in range(classes):
        error = F.col("p")[k] - F.when(F.col("y") == k, 1.0).otherwise(0.0)
        parts += [F.abs(F.avg(error)), *[F.abs(F.avg(error * F.col("x")[j])) for j in range(size)]]
    return scored.agg(F.count("*").alias("num_rows"), F.array_max(F.array(*parts)).alias("max_gradient"))


def _with_label_names(model: PipelineModel) -> PipelineModel:
    """Adds ``predicted``, the name of the predicted class."""
    indexer = next(s for s in model.stages if s.hasParam("outputCol") and s.getOutputCol() == "label")
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=list(indexer.labels))
    return PipelineModel(stages=[*model.stages, names])


def fit_linear(
    df: DataFrame,
    numeric: Sequence[str] = REGRESSOR_FEATURES,
    category: str | None = "activity_type",
    label: str = "calories_burned",
) -> PipelineModel:
    """Least squares on numeric columns and, when given, a one-hot category."""
    stages = []
    inputs = list(numeric)
    if category:
        stages = [string_indexer(category, "activity_idx"), one_hot("activity_idx", "activity_vec")]
        inputs.append("activity_vec")
    stages += [assembler(inputs), LinearRegression(featuresCol="features", labelCol=label)]
    with training_frame(df, *numeric, *([category] if category else []), label) as rows:
        return Pipeline(stages=stages).fit(rows)


# Rows up to which a forest is grown row by row, values that Spark's forests tell apart in a column, tasks
# that sketch their quantiles, and trees of a merged forest that are grown at a time.
MERGE_ABOVE = 100_000
BINS = 32
SKETCHES = 64
TREES_AT_ONCE = 8
# Shares of the numbers 0, 1, 2, ... among Poisson draws of mean 1, added up.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(16))


def fit_forest_classifier(
    df: DataFrame,
    features: Sequence[str] = CLASSIFIER_FEATURES,
    label: str = "activity_type",
    size: ForestSize = LIGHT,
    seed: int = 42,
    merge_above: int = MERGE_ABOVE,
) -> PipelineModel:
    """Median imputation, population scaling, random forest; see :func:`grow_merged` for many rows."""
    with training_frame(df, *features, label) as rows:
        scaled = [f"{c}_scaled" for c in features]
        stages = [fit_impute_scale(rows, features), string_indexer(label, "label"), assembler(scaled)]
        forest = RandomForestClassifier(
            labelCol="label",
            featuresCol="features",
            numTrees=size.trees,
            maxDepth=size.depth,
            minInstancesPerNode=size.leaf,
            seed=seed,
        )
        if rows.count() > merge_above:
            return _with_label_names(grow_merged(rows, forest, stages, scaled, "label"))
        return _with_label_names(Pipeline(stages=[*stages, forest]).fit(rows))


def regression_preprocessing(rows: DataFrame, numeric: Sequence[str], category: str) -> list:
    """Numeric columns imputed and scaled beside a category whose unseen values are all zeros."""
    return [
        fit_impute_scale(rows, numeric),
        string_indexer(category, "activity_idx", unseen="keep"),
        one_hot("activity_idx", "activity_vec"),
        assembler([*[f"{c}_scaled" for c in numeric], "activity_vec"]),
    ]


def fit_forest_regressor(
    df: DataFrame,
    numeric: Sequence[str] = REGRESSOR_FEATURES,
    category: str = "activity_type",
    label: str = "calories_burned",
    size: ForestSize = LIGHT,
    seed: int = 42,
    merge_above: int = MERGE_ABOVE,
) -> PipelineModel:
    with training_frame(df, *numeric, category, label) as rows:
        forest = RandomForestRegressor(
            labelCol=label,
            featuresCol="features",
            numTrees=size.trees,
            maxDepth=size.depth,
            minInstancesPerNode=size.leaf,
            seed=seed,
        )
        stages = regression_preprocessing(rows, numeric, category)
        if rows.count() > merge_above:
            return grow_merged(rows, forest, stages, [f"{c}_scaled" for c in numeric], "activity_idx")
        return Pipeline(stages=[*stages, forest]).fit(rows)


def fit_bins(df: DataFrame, columns: Sequence[str]) -> list[Transformer]:
    """Stages that add ``<column>_bin``, the number of the column's cuts that a value reaches, for trees that
    tell at most BINS values apart: cuts between all values if there are no more, else quantiles of all rows,
    off by a ten-thousandth of the rows at most."""
    shares = [i / BINS for i in range(1, BINS)]
    quantiles = [F.percentile_approx(c, shares, 10_000).alias(f"{c}__cuts") for c in columns]
    # One task merges the sketches, so their number is bounded.
    found = df.coalesce(SKETCHES).agg(*quantiles, *[F.approx_count_distinct(c).alias(f"{c}__distinct") for c in columns]).first()
    splits = []
    for c in columns:
        cuts = sorted(set(found[f"{c}__cuts"]))
        # The count is off by a few hundredths; the exact one has few groups then.
        if found[f"{c}__distinct"] <= 2 * BINS:
            values = sorted(r[0] for r in df.select(c).distinct().collect())
            if len(values) <= BINS:
                cuts = values[1:] or values
        splits.append([-math.inf, *cuts, math.inf])
    cut = Bucketizer(splitsArray=splits, inputCols=list(columns), outputCols=[f"{c}_cut" for c in columns])
    # A sum has no attributes of categories, so that trees take the numbers in their order.
    terms = ", ".join(f"{c}_cut + 0D AS {c}_bin" for c in columns)
    return [cut, SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")]


def grow_merged(
    rows: DataFrame, forest: RandomForestClassifier | RandomForestRegressor, stages: list, scaled: Sequence[str], group: str
) -> PipelineModel:
    """The pipeline of ``stages`` and ``forest``, grown on rows merged by what its trees can tell apart.

    A forest tells at most BINS values of a column apart, so rows of the same bins and ``group`` (the
    label of a classifier, the category of a regressor) go the same way in every tree. Every row is
    drawn for every tree by Poisson numbers of mean 1, as in Spark's own forest; the sum of the
    draws becomes the weight of the merged row, and a regressor's target the mean of the drawn ones,
    which decides splits and leaves as the single values do. A tree is then grown on as many rows as
    there are combinations of bins, and the rows themselves are read once for each GROUP_TREES trees.
    """
    classify, target = isinstance(forest, RandomForestClassifier), forest.getLabelCol()
    *prepare, last = stages
    prepared = Pipeline(stages=prepare).fit(rows)
    bins = [f"{c}_bin" for c in scaled]
    binned = PipelineModel(stages=fit_bins(prepared.transform(rows), scaled))
    assemble = assembler([dict(zip(scaled, bins)).get(c, c) for c in last.getInputCols()])
    ready = binned.transform(prepared.transform(rows))
    encode = PipelineModel(stages=[*[s for s in prepared.stages if isinstance(s, OneHotEncoderModel)], assemble])
    count, seed = forest.getNumTrees(), forest.getSeed()
    grown = []
    for first in range(0, count, GROUP_TREES):
        trees = range(first, min(count, first + GROUP_TREES))
        drawn = ready.select(*bins, group, *([] if classify else [target]), *[F.rand(seed + t).alias(f"u{t}") for t in trees])
        numbers = [[-math.inf, *POISSON, math.inf]] * len(trees)
        drawn = Bucketizer(splitsArray=numbers, inputCols=[f"u{t}" for t in trees], outputCols=[f"k{t}" for t in trees]).transform(drawn)
        sums = [F.sum(f"k{t}").alias(f"w{t}") for t in trees]
        if not classify:
            # A missing target stays missing, for the forest to refuse it.
            known = F.count(target) == F.count("*")
            sums += [F.when(known, F.sum(F.col(f"k{t}") * F.col(target)) / F.nullif(F.sum(f"k{t}"), F.lit(0.0))).alias(f"y{t}") for t in trees]
        merged = materialise(drawn.groupBy(*bins, group).agg(*sums), "merged-rows")
        with training_frame(merged, *merged.columns) as kept:
            totals = kept.agg(*[F.sum(f"w{t}").alias(f"w{t}") for t in trees]).first()
            table = encode.transform(kept)

            def grow(t: int):
                least = (forest.getMinInstancesPerNode() - 0.5) / max(1.0, totals[f"w{t}"])
                tree = forest.copy(
                    {
                        forest.numTrees: 1,
                        forest.bootstrap: False,
                        forest.featureSubsetStrategy: "sqrt" if classify else "onethird",
                        forest.weightCol: f"w{t}",
                        forest.labelCol: target if classify else f"y{t}",
                        forest.minInstancesPerNode: 1,
                        forest.minWeightFractionPerNode: min(0.499, least),
                        forest.seed: seed + t,
                    }
                )
                return tree.fit(table.where(F.col(f"w{t}") > 0))

            pool = ThreadPool(TREES_AT_ONCE)
            try:
                grown += pool.map(inheritable_thread_target(rows.sparkSession)(grow), list(trees))
            finally:
                pool.close()
    return PipelineModel(stages=[*prepared.stages, *binned.stages, assemble, _one_forest(forest, grown)])


def _one_forest(forest: RandomForestClassifier | RandomForestRegressor, grown: Sequence):
    """Forests of one tree each as one model of ``forest``."""
    gateway = SparkContext._gateway
    package = gateway.jvm.org.apache.spark.ml
    classify = isinstance(forest, RandomForestClassifier)
    kind = package.classification.DecisionTreeClassificationModel if classify else package.regression.DecisionTreeRegressionModel
    trees = gateway.new_array(kind, len(grown))
    for i, model in enumerate(grown):
        trees[i] = model._java_obj.trees()[0]
    size = grown[0].numFeatures
    if classify:
        joined = package.classification.RandomForestClassificationModel(forest.uid, trees, size, grown[0].numClasses)
    else:
        joined = package.regression.RandomForestRegressionModel(forest.uid, trees, size)
    model = forest._copyValues(forest._create_model(joined))
    # A regressor divides by the number of trees among its parameters.
    model._transfer_params_to_java()
    return model


# Trees that are grown and held together, and rows that each group is grown on at most (about).
GROUP_TREES = 10
GROUP_ROWS = 1_000_000


def fit_forest_groups(
    df: DataFrame,
    path: str,
    classify: bool,
    size: ForestSize = FULL,
    group_trees: int = GROUP_TREES,
    group_rows: int = GROUP_ROWS,
    seed: int = 42,
) -> int:
    """A forest of the full size, grown and stored below ``path`` in groups of trees; their number.

    Deep trees with single-row leaves are as large as their data, so each group is grown on a sample
    of about ``group_rows`` rows, chosen anew by a hash of the row, or on all rows if there are no
    more. The preparation is fitted on all rows. Only one group at a time is in the driver's memory;
    :func:`score_forest_groups` averages them.
    """
    numeric = CLASSIFIER_FEATURES if classify else REGRESSOR_FEATURES
    label = "activity_type" if classify else "calories_burned"
    with training_frame(df, *dict.fromkeys((*numeric, "activity_type", label))) as rows:
        if classify:
            stages = [fit_impute_scale(rows, numeric), string_indexer(label, "label"), assembler([f"{c}_scaled" for c in numeric])]
        else:
            stages = regression_preprocessing(rows, numeric, "activity_type")
        prepare = Pipeline(stages=stages).fit(rows)
        prepare.write().overwrite().save(f"{path}/prepare")
        ready, share = prepare.transform(rows), group_rows / max(1, rows.count())
        groups = -(-size.trees // group_trees)
        for g in range(groups):
            part = ready.where(hash_unit(rows.columns, seed + g) < share) if share < 1 else ready
            forest = (RandomForestClassifier if classify else RandomForestRegressor)(
                labelCol="label" if classify else label,
                featuresCol="features",
                numTrees=min(group_trees, size.trees - g * group_trees),
                maxDepth=size.depth,
                minInstancesPerNode=size.leaf,
                seed=seed + g,
            )
            forest.fit(part).write().overwrite().save(f"{path}/group={g}")
    return groups


def score_forest_groups(df: DataFrame, path: str, groups: int, classify: bool) -> DataFrame:
    """``df`` with the prediction of a forest stored in groups: the mean over all its trees.

    A classifier adds ``probability`` (array) and ``predicted``, the name of the likeliest class, of
    equal ones the more frequent. A group's shares are added to the rows and the rows written out before
    the next group is loaded.
    """
    prepare = PipelineModel.load(f"{path}/prepare")
    load = RandomForestClassificationModel.load if classify else RandomForestRegressionModel.load
    rows, total, trees = df, free_column(df, "_sum"), 0
    for g in range(groups):
        model = load(f"{path}/group={g}")
        count = model.getNumTrees
        scored = model.transform(prepare.transform(rows))
        if classify:
            share = F.transform(vector_to_array("probability"), lambda p: p * count)
            added = share if g == 0 else F.zip_with(total, share, lambda a, b: a + b)
        else:
            added = F.col("prediction") * count + (0.0 if g == 0 else F.col(total))
        rows = materialise(scored.withColumn(total, added).select(*df.columns, total), "forest-group")
        trees += count
    if not classify:
        return rows.withColumn("prediction", F.col(total) / trees).drop(total)
    indexer = next(s for s in prepare.stages if s.hasParam("outputCol") and s.getOutputCol() == "label")
    probability = F.transform(F.col(total), lambda p: p / trees)
    names = F.array(*[F.lit(n) for n in indexer.labels])
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    return rows.withColumn("probability", probability).withColumn("predicted", F.element_at(names, best)).drop(total)


def free_column(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def fit_segments_scaled(profiles: DataFrame, k: int = 3, seed: int = 1) -> PipelineModel:
    """K-means on centred profiles divided by the sample deviation; one start."""
    stages = [
        assembler(PROFILE_FEATURES, "features_unscaled"),
        StandardScaler(inputCol="features_unscaled", outputCol="features", withStd=True, withMean=True),
        KMeans(featuresCol="features", k=k, seed=seed),
    ]
    with training_frame(profiles, *PROFILE_FEATURES) as rows:
        return Pipeline(stages=stages).fit(rows)


def best_kmeans(rows: DataFrame, k: int, seeds: Iterable[int], parallelism: int = 4) -> KMeansModel:
    """The start with the lowest training cost; equal costs go to the smaller seed."""

    def fit(seed: int) -> tuple[float, int, KMeansModel]:
        model = KMeans(featuresCol="features", k=k, seed=seed).fit(rows)
        return model.summary.trainingCost, seed, model

    pool = ThreadPool(parallelism)
    try:
        fits = pool.map(inheritable_thread_target(rows.sparkSession)(fit), list(seeds))
    finally:
        pool.close()
    return min(fits, key=lambda f: f[:2])[2]


def fit_segments_restarts(
    profiles: DataFrame, k: int = 5, seed: int = 42, restarts: int = 20
) -> PipelineModel:
    """K-means on imputed, population-scaled profiles; the best of several starts."""
    with training_frame(profiles, *PROFILE_FEATURES) as rows:
        prepare = [
            fit_impute_scale(rows, PROFILE_FEATURES),
            assembler([f"{c}_scaled" for c in PROFILE_FEATURES]),
        ]
        ready = PipelineModel(stages=prepare).transform(rows).select("features")
        with training_frame(ready, "features") as vectors:
            best = best_kmeans(vectors, k, range(seed, seed + restarts))
    return PipelineModel(stages=[*prepare, best])


def profiles_of(df: DataFrame) -> DataFrame:
    """User profiles of a telemetry frame, written out: fitting and scoring both read them."""
    return materialise(user_profile(df), "profiles")


def segment_users(model: PipelineModel, profiles: DataFrame) -> DataFrame:
    """Cluster of every user."""
    return model.transform(profiles).select("user_id", *PROFILE_FEATURES, "prediction")


def segment_users_stored(path: str, profiles: DataFrame) -> DataFrame:
    """Clusters by a stored model; no rows when there is no model at ``path``."""
    spark = profiles.sparkSession
    try:
        spark.read.text(f"{path}/metadata")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SEGMENTS)
    return segment_users(load_model(path), profiles)


def cluster_quality(profiles: DataFrame, ks: Iterable[int] = range(2, 9), seed: int = 42) -> DataFrame:
    """Silhouette and within-cluster cost for each number of clusters; see :func:`score_centres`."""
    with training_frame(profiles, *PROFILE_FEATURES) as rows:
        prepare = PipelineModel(
            stages=[
                fit_impute_scale(rows, PROFILE_FEATURES),
                assembler([f"{c}_scaled" for c in PROFILE_FEATURES]),
            ]
        )
        with training_frame(prepare.transform(rows), "features") as vectors:
            fits = {k: KMeans(featuresCol="features", k=k, seed=seed).fit(vectors) for k in ks}
            centres = {k: [list(map(float, c)) for c in model.clusterCenters()] for k, model in fits.items()}
            return materialise(score_centres(vectors, centres), "cluster_quality")


def score_centres(vectors: DataFrame, centres: dict[int, list[list[float]]], features: str = "features") -> DataFrame:
    """(k, silhouette, cost) of several sets of centres, from two scans for all of them.

    Every row is assigned to its nearest centre of every set at once. The first scan sums the
    vectors and their squared lengths per set and cluster; the mean squared distance of a row to a
    cluster follows from those sums, so the second scan has the silhouette of every row. Rows alone
    in their cluster have 0, and a set of whose clusters only one has rows has null.
    """
    spark = vectors.sparkSession
    sets = rows_of_centres(spark, centres)
    point = vectors.select(vector_to_array(features).alias("x"))

    def distance(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)

    def nearest(x: Column, points: Column) -> Column:
        scored = F.transform(points, lambda c, i: F.struct(distance(x, c).alias("d"), i.alias("cluster")))
        return F.array_min(scored)

    listed = F.array_sort(F.collect_list(F.struct("k", "centres")))
    each = point.withColumn("set", F.explode(sets.agg(listed).scalar())).select("x", F.col("set.k").alias("k"), F.col("set.centres").alias("c"))
    assigned = each.withColumn("at", nearest(F.col("x"), F.col("c"))).select("k", "x", "at.cluster", "at.d")
    size = len(next(iter(centres.values()))[0])
    length = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
    sums = assigned.groupBy("k", "cluster").agg(
        F.count("*").alias("n"),
        F.sum("d").alias("cost"),
        F.sum(length).alias("squares"),
        F.array(*[F.sum(F.col("x")[i]) for i in range(size)]).alias("total"),
    )
    # A row per set and cluster: as small as the sets of centres themselves.
    sums = materialise(sums, "cluster_sums")
    clusters = sums.groupBy("k").agg(F.collect_list(F.struct("cluster", "n", "squares", "total")).alias("clusters"))

    def mean_distance(x: Column, c: Column, n: Column) -> Column:
        """Sum of the squared distances of ``x`` to the rows of a cluster, over ``n``."""
        dot = F.aggregate(F.zip_with(x, c["total"], lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        square = F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)
        return (c["n"] * square + c["squares"] - 2 * dot) / n

    joined = assigned.join(clusters, "k").where(F.size("clusters") > 1)
    own = F.filter("clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("clusters", lambda c: c["cluster"] != F.col("cluster"))
    inner = mean_distance(F.col("x"), F.col("own"), F.greatest(F.col("own")["n"] - 1, F.lit(1)))
    outer = F.array_min(F.transform(others, lambda c: mean_distance(F.col("x"), c, c["n"])))
    scored = joined.withColumn("own", own).withColumns({"a": inner, "b": outer})
    value = F.when(F.col("own")["n"] == 1, 0.0).when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b"))
    value = value.when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(0.0)
    mean = scored.groupBy("k").agg(F.avg(value).alias("silhouette"))
    cost = sums.groupBy("k").agg(F.sum("cost").alias("cost"))
    return cost.join(mean, "k", "left").select("k", "silhouette", "cost").orderBy("k")


def rows_of_centres(spark: SparkSession, centres: dict[int, list[list[float]]]) -> DataFrame:
    return literal_rows(spark, sorted(centres.items()), "k int, centres array<array<double>>")


def silhouette(scored: DataFrame, features: str = "features") -> float:
    """Mean silhouette, or null where all rows fell into one cluster."""
    clusters = scored.agg(F.count_distinct("prediction")).first()[0]
    if clusters < 2:
        return None
    return float(ClusteringEvaluator(featuresCol=features).evaluate(scored))


def feature_importance(model: PipelineModel, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importance per feature, largest first."""
    forest = next(s for s in model.stages if hasattr(s, "featureImportances"))
    values = [(n, float(v)) for n, v in zip(names, forest.featureImportances.toArray())]
    return literal_rows(spark, values, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def most_confident(scored: DataFrame, n: int = 10, tie_break: Sequence[str] = ()) -> DataFrame:
    """The ``n`` predictions with the highest class probability."""
    return (
        scored.withColumn("confidence", F.array_max(vector_to_array("probability")))
        .orderBy(F.desc("confidence"), *tie_break)
        .limit(n)
    )


def save_model(model: PipelineModel, path: str, features: Sequence[str] | None = None) -> None:
    """Stores the pipeline and, beside it, the names of its input columns."""
    model.write().overwrite().save(path)
    if features is not None:
        spark = SparkSession.active()
        names = literal_rows(spark, list(enumerate(features)), "position int, feature string")
        names.coalesce(1).write.mode("overwrite").json(f"{path}_features")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_features(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("position int, feature string").json(f"{path}_features")
    return [r["feature"] for r in rows.orderBy("position").collect()]
