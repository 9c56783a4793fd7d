"""Readers: trees of daily files, the partitioned table, and inputs that may be absent."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paceframe.functions.columns import nan_to_null


def read_tree(
    spark: SparkSession,
    root: str | Sequence[str],
    schema: T.StructType | None = None,
    glob: str | None = "*.parquet",
) -> DataFrame:
    """All Parquet files below ``root``.

    Folder names such as ``year=2023`` are not read as columns. Spark lists the tree itself
    (in parallel beyond a few paths); files of other formats beside the Parquet ones are
    skipped by ``glob``. NaN becomes null.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.parquet(*([root] if isinstance(root, str) else root)))


def read_existing(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, glob: str | None = "*.parquet"
) -> DataFrame:
    """Rows of those ``paths`` that exist; an empty frame with ``schema`` when none does."""
    frames = []
    for path in paths:
        try:
            frames.append(read_tree(spark, path, schema, glob))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return concat(frames) if frames else spark.createDataFrame([], schema)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns absent from one side become null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)


def read_processed(
    spark: SparkSession,
    path: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The partitioned table, optionally limited to ``start <= date <= end``.

    A predicate on ``date`` alone prunes no folders, so the range is also stated on the
    partition columns.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = nan_to_null(reader.parquet(path))
    period = F.col("year") * 12 + F.col("month")
    if start is not None:
        df = df.where((period >= start.year * 12 + start.month) & (F.col("date") >= F.lit(start)))
    if end is not None:
        df = df.where((period <= end.year * 12 + end.month) & (F.col("date") <= F.lit(end)))
    return df


def rows(spark: SparkSession, values: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small literal table, handed over as Arrow so that the plan holds it as local data."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = struct.fieldNames()
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(
        pa.Table.from_pylist([dict(zip(names, row)) for row in values], schema=arrow), struct
    )


def read_csv_tree(spark: SparkSession, root: str, schema: T.StructType, glob: str = "*.csv") -> DataFrame:
    """All CSV files with header below ``root``, with a declared schema."""
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .csv(root)
    )
