"""What the operators of this package share."""

from __future__ import annotations

import sys
import types
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space, the only characters that separate words.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE_RUN, -1), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    """Faster than ``translate``, which maps every character of a text."""
    return reduce(lambda rest, c: F.replace(rest, F.lit(c), F.lit("")), characters, text)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_memory() -> dict:
    """A dict that outlives the tasks of a worker process; functions that travel by value get new
    globals in every task."""
    name = "paceframe_worker_memory"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__
