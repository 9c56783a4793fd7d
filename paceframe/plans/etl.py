"""The nightly batch job: daily files in, features added, partitioned table out.

    spark-submit -m paceframe.plans.etl RAW_ROOT PROCESSED_PATH
"""

from __future__ import annotations

import argparse
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paceframe.functions.columns import nan_to_null, parse_date
from paceframe.functions.features import add_features, add_partition_columns
from paceframe.schemas import RAW_DAILY
from paceframe.session import build_session
from paceframe.sources.readers import read_tree
from paceframe.sources.writers import write_processed


class EtlResult(NamedTuple):
    found_input: bool
    num_records: int
    num_undated: int


def transform(raw: DataFrame, strict_dates: bool = True) -> DataFrame:
    """Typed dates, features and partition columns."""
    dated = nan_to_null(raw).withColumn("date", parse_date("date", strict_dates))
    return add_partition_columns(add_features(dated))


def run(
    spark: SparkSession,
    raw_root: str,
    processed_path: str,
    overwrite: str = "static",
    strict_dates: bool = True,
) -> EtlResult:
    """Reads, transforms and writes in one pass; the counts are observed on the way.

    Spark packs files into tasks by length and not by date, so the rows are rebalanced by month:
    a month has one file, or several where it is big.
    """
    try:
        raw = read_tree(spark, raw_root, RAW_DAILY)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return EtlResult(False, 0, 0)
    if raw.isEmpty():
        return EtlResult(False, 0, 0)
    counts = Observation("etl")
    observed = transform(raw, strict_dates).observe(
        counts, F.count(F.lit(1)).alias("records"), F.count_if(F.col("date").isNull()).alias("undated")
    )
    write_processed(observed, processed_path, overwrite=overwrite, rebalance=True)
    return EtlResult(True, counts.get["records"], counts.get["undated"])


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("raw_root")
    parser.add_argument("processed_path")
    parser.add_argument("--overwrite", choices=("static", "dynamic"), default="static")
    options = parser.parse_args(argv)
    spark = build_session("paceframe-etl")
    result = run(
        spark,
        options.raw_root,
        options.processed_path,
        overwrite=options.overwrite,
    )
    if result.found_input:
        print(f"{result.num_records} records written, {result.num_undated} without a date")
    else:
        print("no Parquet files found, nothing written")


if __name__ == "__main__":
    main()
