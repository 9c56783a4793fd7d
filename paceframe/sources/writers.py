"""Writers: the partitioned table, the raw daily layout, JSON documents."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceframe.session import materialise
from paceframe.sources.files import Files


def write_processed(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = ("year", "month"),
    overwrite: str = "static",
    rebalance: bool = True,
) -> None:
    """Parquet partitioned by ``partition_by``, replacing what is there.

    ``overwrite="static"`` replaces the whole table, ``"dynamic"`` only the partitions
    present in ``df``. With ``rebalance`` rows are shuffled by partition so that each folder
    gets few files; adaptive execution splits a folder that is too big for one task and
    merges small ones. Leave it out for input that already arrives clustered by date: each
    task then holds few months and the shuffle of the whole table is saved.
    """
    if overwrite not in ("static", "dynamic"):
        raise ValueError("overwrite must be 'static' or 'dynamic'")
    laid_out = df.hint("rebalance", *partition_by) if rebalance else df
    (
        laid_out.write.mode("overwrite")
        .option("partitionOverwriteMode", overwrite)
        .partitionBy(*partition_by)
        .parquet(path)
    )


# How each format of the raw layout is written, and the ending of its files.
RAW_FORMATS = {"parquet": {}, "csv": {"header": "true"}}
MANIFEST = "_raw_layout.json"


def write_raw_layout(df: DataFrame, path: str, *formats: str, rebalance: bool = True) -> None:
    """Daily folders ``year=YYYY/month=MM/day=DD`` with two-digit months and days, in one or more
    ``formats`` (Parquet when none is given) side by side in the same folders.

    The files of the formats written are replaced in the whole tree, those of other formats stay;
    readers pick one by the ending of its files. Each format is written to a staging folder first.
    A manifest then lists every file to move in and every old one to delete: from there on the
    write is completed, if need be by the next one or by :func:`finish_raw_layout`, and before it
    the old files are all there. Days are moved one by one.
    """
    formats = formats or ("parquet",)
    unknown = [f for f in formats if f not in RAW_FORMATS]
    if unknown:
        raise ValueError(f"formats must be among {', '.join(RAW_FORMATS)}")
    spark, path = df.sparkSession, path.rstrip("/")
    files = Files(spark, path)
    finish_raw_layout(spark, path)
    folders = {
        "year": F.date_format("date", "yyyy"),
        "month": F.date_format("date", "MM"),
        "day": F.date_format("date", "dd"),
    }
    dated = df.withColumns(folders)
    if rebalance:
        dated = dated.hint("rebalance", *folders)
    name = uuid.uuid4().hex
    staging = f"{path}/_staging-{name}"
    if len(formats) > 1:
        # Every format has the same rows, also where the input would differ from one reading to the next.
        dated = materialise(dated, "raw-layout")
    for fmt in formats:
        writer = dated.write.partitionBy(*folders).options(**RAW_FORMATS[fmt])
        writer.format(fmt).save(f"{staging}/{fmt}")
    moves = [
        [f"_staging-{name}/{fmt}/{file}", f"{os.path.dirname(file)}/{name}-{os.path.basename(file)}"]
        for fmt in formats
        for file in files.below(f"{staging}/{fmt}")
        if file.endswith(f".{fmt}")
    ]
    endings = tuple(f".{fmt}" for fmt in formats)
    old = [f for f in files.below(path) if f.endswith(endings) and not f.startswith("_")]
    files.put(f"{path}/{MANIFEST}", json.dumps({"staging": f"_staging-{name}", "moves": moves, "old": old}))
    finish_raw_layout(spark, path)


def finish_raw_layout(spark: SparkSession, path: str) -> bool:
    """Completes a write that got as far as its manifest; whether there was one.

    Every step may be repeated. Staging folders without a manifest are what failed writes left.
    """
    files = Files(spark, path)
    manifest = f"{path}/{MANIFEST}"
    pending = files.exists(manifest)
    if pending:
        plan = json.loads(files.read(manifest))
        by_day: dict[str, list] = {}
        for source, target in plan["moves"]:
            by_day.setdefault(os.path.dirname(target), []).append((source, target))
        for file in plan["old"]:
            by_day.setdefault(os.path.dirname(file), []).append((file, None))
        for _, steps in sorted(by_day.items()):
            for source, target in steps:
                if target is None:
                    files.remove(f"{path}/{source}")
                elif files.exists(f"{path}/{source}"):
                    files.move(f"{path}/{source}", f"{path}/{target}")
        files.remove(f"{path}/{plan['staging']}")
        files.remove(manifest)
    for left in files.names(path):
        if left.startswith("_staging-"):
            files.remove(f"{path}/{left}")
    return pending


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
