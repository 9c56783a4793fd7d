"""Stream sinks: checkpointed Parquet, and a memory table for demos; updates go to ``upsert``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

EVERY_5_SECONDS = {"processingTime": "5 seconds"}
AVAILABLE_NOW = {"availableNow": True}


def append_to_parquet(
    stream: DataFrame, path: str, checkpoint: str, name: str | None = None, trigger: dict | None = None
) -> StreamingQuery:
    """Append mode, exactly once: the sink's log and the checkpoint agree on finished batches."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY_5_SECONDS))
    return (writer.queryName(name) if name else writer).start()


def to_memory(
    stream: DataFrame, name: str, mode: str = "append", trigger: dict | None = None
) -> StreamingQuery:
    """A table in the driver's memory, for interactive looks at small streams only."""
    return (
        stream.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .trigger(**(trigger or EVERY_5_SECONDS))
        .start()
    )
