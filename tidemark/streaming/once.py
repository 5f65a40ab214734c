"""Streams that deliver an event more than once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numerics import epoch_micros
from tidemark.specs import EVENT_TIME

_AT = "_at"


def event_instant(events: DataFrame, event_time: str = EVENT_TIME) -> Column:
    """The event time as a timestamp with zone, which is what a watermark stands on."""
    return F.timestamp_micros(epoch_micros(F.col(event_time), events.schema[event_time].dataType))


def _named(ids: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ids])


def once(stream: DataFrame, ids: Sequence[str], delay: str, event_time: str = EVENT_TIME) -> DataFrame:
    """Each event of ``stream`` once, by its ``ids``, for sources that repeat events after a failure.

    ``delay`` is how far an event may come behind the newest one. Spark keeps the ids of that span
    and no more, so state follows the span and not the stream. An event further behind is dropped,
    as nobody knows any more whether it came before; ``missed`` finds those. Events with a null among
    their ids or without a time can't be told apart and pass as they are.
    """
    known = _named(ids) & F.col(event_time).isNotNull()
    timed = stream.where(known).withColumn(_AT, event_instant(stream, event_time))
    single = timed.withWatermark(_AT, delay).dropDuplicatesWithinWatermark(list(ids)).drop(_AT)
    return single.union(stream.where(~known))


def missed(arrivals: DataFrame, taken: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Events among ``arrivals`` that are not in ``taken``, each once: what came beyond the delay."""
    return arrivals.where(_named(ids)).dropDuplicates(list(ids)).join(taken, list(ids), "left_anti")
