"""Latest state kept by a streaming aggregation."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.latest import latest_values
from tidemark.sources.state import StateTable
from tidemark.specs import FeatureView


def latest_stream(events: DataFrame, view: FeatureView) -> DataFrame:
    """The newest value per entity and feature, by event time; late events never win.

    The same aggregation as in batch. Spark combines the events of a key within each task
    before the shuffle and keeps one row per entity in its state store.
    """
    return latest_values(events, view)


def start_latest(
    state: StateTable,
    stream: DataFrame,
    *,
    checkpoint: str,
    name: str,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Write the entities that changed in each micro-batch as a delta of the state table."""

    def write(changed: DataFrame, batch_id: int) -> None:
        state.upsert(changed, batch=f"{name}-{batch_id:020d}")

    return (
        latest_stream(stream, state.view)
        .writeStream.queryName(name)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )
