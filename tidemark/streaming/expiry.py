"""Latest state of a stream that forgets what has outlived the view's TTL.

``streaming.latest`` keeps one row per entity for ever. Here the newest values are kept per entity and
slice of event time, a quarter of the TTL long, and Spark drops a slice once the watermark has passed its
end. So the state holds entities seen within one TTL and a quarter, not all there ever were, each with at
most as many rows as there are slices in that span. It is Spark's own aggregation, combined within
each task before the shuffle; no entity is handled by itself in Python.

The watermark stays a TTL (and a second, as it is coarser than event time) behind the newest event.
A slice behind it holds only what has expired by then, and events that still come for it are passed over.
What is left equals the TTL rule applied when reading, at any moment from the newest event on.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.numerics import MICROS
from tidemark.operators.latest import latest_values
from tidemark.sources.state import StateTable
from tidemark.specs import ENTITY_KEY, EVENT_TIME, FeatureView
from tidemark.streaming.once import event_instant

_AT = "_at"
SLICES = 4


def expiring_stream(events: DataFrame, view: FeatureView) -> DataFrame:
    """Entities that changed in a micro-batch, as cells ``struct<value, ts, created, tie>`` per feature, one
    row for each slice of time that changed. Needs a TTL."""
    if view.ttl_seconds is None:
        raise ValueError(f"view {view.name!r} has no TTL, so nothing expires")
    timed = (
        events.where(F.col(ENTITY_KEY).isNotNull() & F.col(EVENT_TIME).isNotNull())
        .withColumn(ENTITY_KEY, F.col(ENTITY_KEY).cast("string"))
        .withColumn(_AT, event_instant(events))
        .withWatermark(_AT, f"{view.ttl_seconds + 1} seconds")
    )
    slice_ = F.window(_AT, f"{max(view.ttl_seconds * MICROS // SLICES, 1)} microseconds")
    return latest_values(timed, view, slice_)


def start_expiring(
    state: StateTable,
    stream: DataFrame,
    *,
    checkpoint: str,
    name: str,
    trigger: dict[str, Any] | None = None,
) -> StreamingQuery:
    """Write the entities that changed in each micro-batch as a delta of the state table."""

    def known(changed: DataFrame) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in changed.columns if c != ENTITY_KEY])

    def write(changed: DataFrame, batch_id: int) -> None:
        state.upsert(changed.where(known(changed)), batch=f"{name}-{batch_id:020d}")

    return (
        expiring_stream(stream, state.view)
        .writeStream.queryName(name)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )
