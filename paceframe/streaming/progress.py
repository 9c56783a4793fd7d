"""Figures of streams over their whole life.

A query object remembers its last 100 batches only, and nothing across restarts. Here a listener
writes the progress of every batch to a file of its own, named by query and batch, so that a batch
that is repeated after a failure counts once; a table of them has the totals.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from paceframe.sources.files import Files

PROGRESS = "id string, name string, batch long, timestamp string, num_input_rows long, num_late_groups long, state_rows long"
FLUSH_MS = 60_000


class ProgressLog(StreamingQueryListener):
    """Writes what every batch of the session's streams reports below ``path``, one line a file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.flush()
        self.spark.streams.removeListener(self)

    def flush(self) -> None:
        """Waits for the reports that are still on their way."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(FLUSH_MS)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        line = {
            "id": str(p.id),
            "name": p.name,
            "batch": p.batchId,
            "timestamp": p.timestamp,
            "num_input_rows": p.numInputRows,
            "num_late_groups": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
        }
        self.files.put(f"{self.path}/id={p.id}/{p.batchId:020d}.json", json.dumps(line), replace=True)


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """One row a batch. ``num_late_groups`` counts the keys whose late rows a batch dropped."""
    return spark.read.schema(PROGRESS).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Batches, input rows and late groups of each query over all its batches and restarts."""
    return progress_table(spark, path).groupBy("id").agg(
        F.max_by("name", "batch").alias("name"),
        F.count("*").alias("num_batches"),
        F.sum("num_input_rows").alias("num_input_rows"),
        F.sum("num_late_groups").alias("num_late_groups"),
    )
