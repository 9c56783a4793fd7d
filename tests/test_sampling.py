from pyspark.sql import functions as F

from paceframe.functions.columns import hash_digest
from paceframe.operators import sampling


def test_split_is_complete_and_independent_of_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    for portable in (True, False):
        train, test = sampling.hash_split(df, ("k",), portable=portable)
        again, _ = sampling.hash_split(df.repartition(7), ("k",), portable=portable)
        first, second = {r["k"] for r in train.collect()}, {r["k"] for r in test.collect()}
        assert not first & second and len(first | second) == 5000
        assert first == {r["k"] for r in again.collect()}
        assert 0.77 < len(first) / 5000 < 0.83


def test_split_depends_on_the_seed(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r["k"] for r in sampling.hash_split(df, ("k",), seed=1)[0].collect()}
    two = {r["k"] for r in sampling.hash_split(df, ("k",), seed=2)[0].collect()}
    assert one != two


def test_prefilter_does_not_change_the_sample(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    cut = {r["k"] for r in sampling.fixed_size_sample(df, ("k",), 300).collect()}
    plain = df.orderBy(hash_digest(("k",), 42), "k").limit(300)
    assert {r["k"] for r in plain.collect()} == cut and len(cut) == 300
    assert sampling.fixed_size_sample(df.limit(50), ("k",), 300).count() == 50


def test_repeated_keys_still_fill_the_sample(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"))
    assert sampling.fixed_size_sample(df, ("k",), 300).count() == 300


def test_groups_of_any_size_are_filled(spark):
    group = F.when(F.col("id") < 40, "small").when(F.col("id") < 9000, "hot")
    df = spark.range(10000).select(F.col("id").alias("k"), group.alias("g"))
    cut = sampling.sample_per_group(df, ("g",), ("k",), 100)
    assert {r["k"] for r in sampling.sample_per_group(df.repartition(7), ("g",), ("k",), 100).collect()} == {r["k"] for r in cut.collect()}
    assert {r["g"]: r["count"] for r in cut.groupBy("g").count().collect()} == {"small": 40, "hot": 100, None: 100}


def test_random_split_covers_all_rows(spark):
    train, test = sampling.random_split(spark.range(1000))
    assert train.count() + test.count() == 1000
