"""Looking after running queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery


def finish(query: StreamingQuery) -> StreamingQuery:
    """Waits until the available input is processed; errors of the query are raised."""
    query.awaitTermination()
    return query


def progress(query: StreamingQuery) -> dict[str, Any]:
    """State of a query and the figures of its last batch."""
    last = query.lastProgress
    state = {"name": query.name, "active": query.isActive, "batch_id": None, "num_input_rows": None}
    if last is not None:
        state["batch_id"] = last["batchId"]
        state["num_input_rows"] = last["numInputRows"]
        state["dropped_late_rows"] = sum(
            int(op["numRowsDroppedByWatermark"]) for op in last["stateOperators"]
        )
    return state


def dropped_late_rows(query: StreamingQuery) -> int:
    """Late rows dropped over the batches the query still remembers."""
    return sum(
        int(op["numRowsDroppedByWatermark"])
        for batch in query.recentProgress
        for op in batch["stateOperators"]
    )


def stop_named(spark: SparkSession, name: str) -> bool:
    """Stops the active query of that name, if there is one."""
    for query in spark.streams.active:
        if query.name == name:
            query.stop()
            return True
    return False
