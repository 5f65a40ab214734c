"""Observation grids: regular times for every entity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import micros_of, moment
from tidemark.specs import ENTITY_KEY, EVENT_TIME

# Spacing of the observations.
STEP_HOURS = 4


def observation_grid(
    entities: DataFrame,
    observations: int,
    now: dt.datetime,
    *,
    step: dt.timedelta = dt.timedelta(hours=STEP_HOURS),
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    zoned: bool = True,
) -> DataFrame:
    """``observations`` times per entity, the last one ``step`` before ``now``.

    With ``start`` or ``end`` only the times inside are kept (``end`` also stands in for
    ``now``). The times are the same for all entities, a short literal list that each row
    unfolds in place; there is no join.
    """
    anchor = end or now
    times = [anchor - step * (observations - i) for i in range(observations)]
    times = [t for t in times if start is None or t >= start]
    kind = T.TimestampType() if zoned else T.TimestampNTZType()
    return entities.select(
        F.col(ENTITY_KEY).cast("string").alias(ENTITY_KEY),
        F.explode(F.array(*[moment(micros_of(t), kind) for t in times])).alias(EVENT_TIME),
    )
