"""Streaming ingestion: the batch path, once per micro-batch."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.history import HistoryTable
from tidemark.sources.logs import newest
from tidemark.specs import BATCH, ENTITY_KEY, EVENT_TIME

if TYPE_CHECKING:
    from tidemark.plans.store import FeatureStore


def start_ingest(
    store: FeatureStore,
    view_name: str,
    stream: DataFrame,
    *,
    checkpoint: str,
    name: str,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Transform events, append them to history and update the latest state.

    ``name`` marks the batches of this stream and must stay the same over restarts. A
    micro-batch that is replayed after a failure writes the same folders again, in history
    and in state, so nothing is doubled or lost.
    """
    store.registry.view(view_name)

    def write(events: DataFrame, batch_id: int) -> None:
        store.ingest_batch(view_name, events, batch=f"{name}-{batch_id:020d}")

    return (
        stream.writeStream.queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def recent_events(history: DataFrame, limit: int) -> DataFrame:
    """The newest ingested events, newest first."""
    return newest(history, limit, EVENT_TIME, ENTITY_KEY)


def stream_totals(history: HistoryTable, name: str) -> DataFrame:
    """Rows and batches that stream ``name`` has written, and when it began, from what is stored."""
    own = history.batches().where(F.col(BATCH).rlike(f"^{re.escape(name)}-[0-9]{{20}}$"))
    return own.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_streamed"),
        F.count("*").alias("batches"),
        F.min("first_created").alias("start_time"),
        F.max(F.right(BATCH, F.lit(20)).cast("long")).alias("last_batch"),
    )


def stream_status(query: StreamingQuery) -> dict[str, Any]:
    """Whether the stream runs, and its last progress; for totals see ``stream_totals``."""
    last = query.lastProgress
    return {
        "active": query.isActive,
        "last_batch": last["batchId"] if last else None,
        "rows_per_sec": last.get("processedRowsPerSecond") if last else None,
    }
