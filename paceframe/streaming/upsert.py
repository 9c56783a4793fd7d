"""A keyed table that update-mode streams write to, one committed version a batch.

The table is dealt into buckets by a hash of some of its columns. A batch rewrites only the buckets
its keys fall into, into a folder of its own version, and then commits: a version file, moved into
place in one step, names the folder of every bucket and the batch. Readers see the last committed
version; what a failed batch has left is overwritten by its repetition, and a batch that is
committed already changes nothing. Folders that neither the new version nor the one before needs
are deleted, so the table stays as large as its rows, however many batches there are.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paceframe.sources.files import Files
from paceframe.streaming.sinks import EVERY_5_SECONDS

BUCKETS = 64
BUCKET, NEWER = "_bucket", "_newer"


class Version(NamedTuple):
    """``folders`` has the version that wrote each bucket; ``batch`` is None before any."""

    number: int
    batch: int | None
    folders: dict[int, int]


class KeyedTable:
    """One row a key, below ``path``.

    ``bucket_by`` are the key columns, or some of them, that decide a row's bucket; with a time among
    them only, batches of recent rows touch few buckets. Keys may be null. One writer at a time:
    a second one fails when it commits. ``buckets`` is kept with the table; an existing table has its own.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], bucket_by: Sequence[str] = (), buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.bucket_by, self.buckets = list(bucket_by or keys), buckets
        self.files = Files(spark, path)
        if not set(self.bucket_by) <= set(self.keys):
            raise ValueError("bucket_by must be key columns")

    def _file(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def _load(self, number: int) -> dict[str, Any]:
        return json.loads(self.files.read(self._file(number)))

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json"))

    def version(self) -> Version:
        """The last committed one."""
        numbers = self._numbers()
        if not numbers:
            return Version(0, None, {})
        found = self._load(numbers[-1])
        if found["keys"] != self.keys or found["bucket_by"] != self.bucket_by:
            raise ValueError(f"{self.path} is keyed by {found['keys']}, dealt by {found['bucket_by']}")
        self.buckets = found["buckets"]
        return Version(numbers[-1], found["batch"], {int(k): v for k, v in found["folders"].items()})

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/version={version}/{BUCKET}={bucket}"

    def _stored(self, schema: T.StructType, version: Version, buckets: Sequence[int]) -> DataFrame:
        paths = [self._folder(version.folders[b], b) for b in buckets if b in version.folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, changes: DataFrame, batch: int) -> Version:
        """The rows of ``changes`` take the place of stored rows with their keys.

        Of several rows of a key in ``changes`` the largest by its values stays. Batches are numbered
        upward; one that isn't newer than the last committed one is left out.
        """
        old = self.version()
        if old.batch is not None and batch <= old.batch:
            return old
        changes = changes.persist()
        try:
            return self._merge(changes, batch, old)
        finally:
            changes.unpersist()

    def _merge(self, changes: DataFrame, batch: int, old: Version) -> Version:
        bucket = F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")
        # At most as many rows as there are buckets.
        touched = sorted(r[0] for r in changes.select(bucket.alias("b")).distinct().collect())
        number = old.number + 1
        if touched:
            stored = self._stored(changes.schema, old, touched).withColumn(NEWER, F.lit(False))
            both = stored.unionByName(changes.withColumn(NEWER, F.lit(True)))
            values = [c for c in changes.columns if c not in self.keys]
            # Rows of a key meet by an aggregation with map-side merge; null keys are equal to each other.
            kept = both.groupBy(*self.keys).agg(F.max(F.struct(NEWER, *values)).alias("_row"))
            rows = kept.select(*[F.col(c) if c in self.keys else F.col("_row")[c].alias(c) for c in changes.columns])
            rows = rows.withColumn(BUCKET, bucket).hint("rebalance", BUCKET)
            rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/version={number}")
        folders = {**old.folders, **dict.fromkeys(touched, number)}
        settings = {"keys": self.keys, "bucket_by": self.bucket_by, "buckets": self.buckets, "schema": changes.schema.json()}
        self.files.put(self._file(number), json.dumps({**settings, "batch": batch, "folders": folders}))
        self._clean(old, folders, number)
        return Version(number, batch, folders)

    def _clean(self, old: Version, folders: dict[int, int], number: int) -> None:
        """Deletes what the new version and the one before don't need."""
        needed = {(v, b) for b, v in [*old.folders.items(), *folders.items()]}
        for name in self.files.names(f"{self.path}/data"):
            version = int(name.partition("=")[2])
            if version > number:
                continue
            buckets = [int(b.partition("=")[2]) for b in self.files.names(f"{self.path}/data/{name}") if b.startswith(BUCKET)]
            if not any((version, b) in needed for b in buckets):
                self.files.remove(f"{self.path}/data/{name}")
                continue
            for b in buckets:
                if (version, b) not in needed:
                    self.files.remove(self._folder(version, b))
        for found in self._numbers()[:-2]:
            self.files.remove(self._file(found))

    def read(self) -> DataFrame:
        """The rows of the last committed version."""
        version = self.version()
        if not version.number:
            raise FileNotFoundError(f"{self.path} has no committed version")
        schema = T.StructType.fromJson(json.loads(self._load(version.number)["schema"]))
        return self._stored(schema, version, sorted(version.folders))


def upsert_to_table(
    stream: DataFrame, table: KeyedTable, checkpoint: str, name: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Update mode: the changed rows of every batch replace those of the same keys in ``table``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(batch, batch_id)

    writer = stream.writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY_5_SECONDS))
    return (writer.queryName(name) if name else writer).start()
