"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


ROCKSDB_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(
    app_name: str = "paceframe", master: str | None = None, rocksdb_state: bool = False, **conf: str
) -> SparkSession:
    """A session pinned to UTC with adaptive execution; cluster sizing comes from ``conf``.

    ``rocksdb_state`` keeps the state of streams on local disk instead of the executors' heap.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if rocksdb_state:
        builder = builder.config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_STATE)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@lru_cache(maxsize=None)
def _local_fallback() -> str:
    return tempfile.mkdtemp(prefix="paceframe-")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is read from the session. Only a local master, where driver and executors are one
    process, may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if spark.sparkContext.master.startswith("local"):
        return _local_fallback()
    raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    root = f"{shared_dir(spark).rstrip('/')}/paceframe-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # Only folders that exist are noted for removal.
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{name}"


def materialise(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with Parquet ``options``, and read it back.

    Cuts the lineage in a way that survives lost executors, and gives Catalyst the real size
    of the table, so that it broadcasts the table only when it is small enough.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
