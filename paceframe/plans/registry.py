"""Collects the named queries of this package."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


class Registry(dict[str, Query]):
    def add(self, function: Query) -> Query:
        """Registers ``function`` under its name; event times are read in UTC."""

        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        if function.__name__ in self:
            raise ValueError(f"query {function.__name__} registered twice")
        self[function.__name__] = run
        return function


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All double columns rounded, for comparison across engines."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df
