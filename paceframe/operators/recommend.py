"""Activity recommendations by alternating least squares."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.operators.preprocessing import string_indexer
from paceframe.session import materialise, shared_dir
from paceframe.sources.readers import rows

INT_MAX = 2**31 - 1
REGULARISATION = 0.01


class IndexedRatings(NamedTuple):
    ratings: DataFrame
    labels: DataFrame
    user_ids: DataFrame | None


def label_table(spark: SparkSession, model: StringIndexerModel) -> DataFrame:
    """(item_id, activity_type), one row per activity."""
    return rows(spark, list(enumerate(model.labels)), "item_id int, activity_type string")


def dense_ids(df: DataFrame, column: str, output: str) -> DataFrame:
    """Consecutive integers for the distinct values of ``column``.

    The values stay in their partitions; only the number of values per partition is collected
    to turn positions within partitions into global ones.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    # Checkpointed, so that partitions and positions are the same in both uses below.
    placed = (
        df.select(column)
        .distinct()
        .withColumn("_at", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["part"], total))
        total += row["n"]
    offsets = rows(spark, starts, "part bigint, start bigint")
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumns({"part": part, "position": position})
        .join(offsets, "part")
        .select(column, (F.col("start") + F.col("position")).alias(output))
    )


def index_ratings(ratings: DataFrame) -> IndexedRatings:
    """Ratings with integer ids, as the factorisation needs them.

    Activities are indexed by frequency among the rating rows. User ids that fit an integer
    are used as they are; others get dense ids first. The ratings are written out once, as
    indexing, checking and fitting each read them.
    """
    spark = ratings.sparkSession
    ratings = materialise(ratings, "ratings")
    indexer = string_indexer("activity_type", "item_id").fit(ratings)
    indexed = indexer.transform(ratings).withColumn("item_id", F.col("item_id").cast("int"))
    low, high = ratings.agg(F.min("user_id"), F.max("user_id")).first()
    if low is None or (low >= -INT_MAX and high <= INT_MAX):
        return IndexedRatings(
            indexed.withColumn("user_no", F.col("user_id").cast("int")), label_table(spark, indexer), None
        )
    users = dense_ids(ratings, "user_id", "user_no").withColumn("user_no", F.col("user_no").cast("int"))
    return IndexedRatings(indexed.join(users, "user_id"), label_table(spark, indexer), users)


def fit_als(indexed: DataFrame, max_iter: int = 5, reg: float = REGULARISATION, seed: int = 42) -> ALSModel:
    """Explicit-feedback factorisation of the activity counts."""
    return ALS(
        maxIter=max_iter,
        regParam=reg,
        userCol="user_no",
        itemCol="item_id",
        ratingCol="rating",
        coldStartStrategy="drop",
        seed=seed,
    ).fit(indexed.withColumn("rating", F.col("rating").cast("float")))


def top_items(model: ALSModel, k: int = 3) -> DataFrame:
    """The best ``k`` items of every user as (user_no, recommendations) lists, equal scores by item."""
    # Written out, since scoring is the costly part and readers may look at the lists again.
    lists = materialise(model.recommendForAllUsers(k), "recommendations")
    ordered = F.array_sort(
        F.transform("recommendations", lambda r: F.struct((-r["rating"]).alias("minus"), r["item_id"].alias("item_id")))
    )
    named = F.transform(ordered, lambda r: F.struct(r["item_id"].alias("item_id"), (-r["minus"]).alias("rating")))
    return lists.select("user_no", named.alias("recommendations"))


def user_residuals(model: ALSModel, ratings: DataFrame, reg: float = REGULARISATION) -> DataFrame:
    """(user_no, residual): how far a user's factors are from solving the user's own system.

    The factorisation ends with the users, so each user's factors u solve (V'V + reg n I) u = V'r for
    the factors V of the n items rated and the ratings r. One aggregation sums the products of every
    user; the residual is the largest difference of the two sides, as a share of the largest of V'r.
    """
    rank = model.rank
    items = model.itemFactors.select(F.col("id").alias("item_id"), F.col("features").cast("array<double>").alias("v"))
    rated = ratings.select("user_no", "item_id", F.col("rating").cast("double").alias("r")).join(items, "item_id")
    pairs = [(i, j) for i in range(rank) for j in range(i, rank)]
    v = F.col("v")
    sums = rated.groupBy("user_no").agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(v[i] * v[j]) for i, j in pairs]).alias("vv"),
        F.array(*[F.sum(v[i] * F.col("r")) for i in range(rank)]).alias("vr"),
    )
    users = model.userFactors.select(F.col("id").alias("user_no"), F.col("features").cast("array<double>").alias("u"))
    both = sums.join(users, "user_no")
    u, at = F.col("u"), {pair: k for k, pair in enumerate(pairs)}
    gaps = []
    for i in range(rank):
        side = reg * F.col("n") * u[i] - F.col("vr")[i]
        for j in range(rank):
            side = side + F.col("vv")[at[min(i, j), max(i, j)]] * u[j]
        gaps.append(F.abs(side))
    largest = F.array_max(F.transform("vr", F.abs))
    return both.select("user_no", (F.array_max(F.array(*gaps)) / F.greatest(largest, F.lit(1e-30))).alias("residual"))


def recommend(model: ALSModel, ratings: IndexedRatings, k: int = 3) -> DataFrame:
    """(user_id, activity_type, score, rank) of the best ``k`` activities of each user."""
    flat = top_items(model, k).select("user_no", F.posexplode("recommendations").alias("at", "rec")).select(
        "user_no",
        (F.col("at") + 1).alias("rank"),
        F.col("rec.item_id").alias("item_id"),
        F.col("rec.rating").cast("double").alias("score"),
    )
    named = flat.join(ratings.labels, "item_id")
    if ratings.user_ids is None:
        named = named.withColumn("user_id", F.col("user_no").cast("bigint"))
    else:
        named = named.join(ratings.user_ids, "user_no")
    return named.select("user_id", "activity_type", "score", "rank")
