"""Splits and samples that depend only on row keys, not on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceframe.functions.columns import digest_unit, hash_digest, hash_unit


def hash_split(
    df: DataFrame, keys: Sequence[str], train: float = 0.8, seed: int = 42, portable: bool = False
) -> tuple[DataFrame, DataFrame]:
    """A training and a test part; a row's side is a function of its key and the seed.

    With ``portable`` the side follows from an MD5 digest that other engines can reproduce;
    otherwise from Spark's faster 64-bit hash.
    """
    unit = digest_unit(keys, seed) if portable else hash_unit(keys, seed)
    return df.where(unit < train), df.where(unit >= train)


def random_split(df: DataFrame, train: float = 0.8, seed: int | None = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's own split; repeatable only for the same partitioning of the input."""
    first, second = df.randomSplit([train, 1.0 - train], seed)
    return first, second


def fixed_size_sample(
    df: DataFrame, keys: Sequence[str], n: int = 2000, seed: int = 42
) -> DataFrame:
    """The ``n`` rows with the smallest key digests (all rows when there are fewer).

    Every task would forward ``n`` rows, so rows whose digest is certainly too large are dropped
    first. The cut is raised until at least ``n`` rows pass it.
    """
    drawn = df.withColumns({"_digest": hash_digest(keys, seed), "_unit": digest_unit(keys, seed)})
    cut = min(1.0, 4.0 * n / max(1, df.count()))
    while cut < 1.0 and drawn.where(F.col("_unit") < cut).limit(n).count() < n:
        cut = min(1.0, cut * 4)
    if cut < 1.0:
        drawn = drawn.where(F.col("_unit") < cut)
    return drawn.orderBy("_digest", *keys).limit(n).drop("_digest", "_unit")


def sample_per_group(
    df: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    n: int = 500,
    seed: int = 42,
) -> DataFrame:
    """Up to ``n`` rows per group, those with the smallest key digests.

    The rank limit is applied within every task too, so at most ``n`` rows of a group leave it.
    """
    drawn = df.withColumns({"_digest": hash_digest(keys, seed), "_unit": digest_unit(keys, seed)})
    order = Window.partitionBy(*by).orderBy("_digest", *keys)
    return drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop(
        "_digest", "_unit", "_rank"
    )
