"""Latest state per entity: reductions of history, lookup and freshness.

A state table has one row per entity and one ``struct<value, ts>`` per feature, so every
feature keeps the time of its own value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import MICROS, epoch_micros, micros_of, round_even
from tidemark.functions.values import typed
from tidemark.operators.slicing import SkewPolicy, join_answers
from tidemark.specs import (
    CREATED_TIME,
    ENTITY_KEY,
    EVENT_TIME,
    FeatureView,
    refs_by_view,
)


@dataclass(frozen=True)
class ViewState:
    """A feature view and its latest state; ``data=None`` stands for a view without state."""

    view: FeatureView
    data: DataFrame | None


def recency(history: DataFrame, view: FeatureView) -> list[str]:
    """Columns that order the rows of one entity, most significant first."""
    extra = [c for c in (CREATED_TIME, view.tie) if c and c in history.columns]
    return [EVENT_TIME, *extra]


def latest_row(history: DataFrame, view: FeatureView) -> DataFrame:
    """Newest row of every entity, nulls included.

    Spark keeps only the first row per entity and map task before the shuffle, so an
    entity with a large part of all rows costs no more than any other.
    """
    newest = Window.partitionBy(ENTITY_KEY).orderBy(
        *[F.col(c).desc_nulls_last() for c in recency(history, view)]
    )
    return (
        history.where(F.col(ENTITY_KEY).isNotNull() & F.col(EVENT_TIME).isNotNull())
        .withColumn("_rn", F.row_number().over(newest))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def latest_values(history: DataFrame, view: FeatureView, *per: Column) -> DataFrame:
    """State from history: the newest non-null value of every feature, with its own time.

    One aggregation with map-side combine: a task sends one row per entity, or per entity and
    values of ``per``.
    """
    order = [F.col(c) for c in recency(history, view)]
    present = [f for f in view.feature_names() if f in history.columns]

    # Time alone orders by a plain number, which keeps Spark on hash aggregation.
    rank = order[0] if len(order) == 1 else F.struct(*order)
    names = recency(history, view)
    picks = []
    for i, feature in enumerate(present):
        value = F.col(f"`{feature}`")
        known = value.isNotNull()
        picks.append(F.max_by(value, F.when(known, rank)).alias(f"_v{i}"))
        picks.append(F.max(F.when(known, rank)).alias(f"_t{i}"))

    def cell(i: int, feature: str) -> Column:
        won = {n: F.col(f"_t{i}") if len(names) == 1 else F.col(f"_t{i}")[n] for n in names}
        return _cell(F.col(f"_v{i}"), won, view, F.col(f"_t{i}").isNotNull()).alias(feature)

    return (
        history.where(F.col(ENTITY_KEY).isNotNull() & F.col(EVENT_TIME).isNotNull())
        .groupBy(ENTITY_KEY, *per)
        .agg(*picks)
        .select(ENTITY_KEY, *[cell(i, f) for i, f in enumerate(present)])
    )


def _cell(value: Column, order: dict[str, Column], view: FeatureView, known: Column) -> Column:
    """A state cell: the value and all that orders it against others."""
    extra = [
        order[c].alias(name)
        for c, name in ((CREATED_TIME, "created"), (view.tie, "tie"))
        if c is not None and c in order
    ]
    return F.when(known, F.struct(value.alias("value"), order[EVENT_TIME].alias("ts"), *extra))


def state_of_rows(rows: DataFrame, view: FeatureView) -> DataFrame:
    """State from one row per entity; only declared features that exist are kept."""
    present = [f for f in view.feature_names() if f in rows.columns]
    order = {c: F.col(f"`{c}`") for c in recency(rows, view)}
    return rows.select(
        ENTITY_KEY,
        *[
            _cell(F.col(f"`{f}`"), order, view, F.col(f"`{f}`").isNotNull()).alias(f)
            for f in present
        ],
    )


def alive(cell: Column, ttl_seconds: int | None, now_us: Column, ts_us: Column) -> Column:
    """Value of a state cell, null once its age exceeds the TTL."""
    value = cell.getField("value")
    if ttl_seconds is None:
        return value
    return F.when(now_us - ts_us <= ttl_seconds * MICROS, value)


def lookup(
    requests: DataFrame,
    states: Mapping[str, ViewState],
    refs: list[str],
    now: dt.datetime,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Add ``view:feature`` columns to ``requests``; one output row per request row.

    Unknown keys and expired values give null. The states are looked up once per distinct
    key, on one partitioning by key for all views; the requests meet the answers in a join
    that stands popular keys. For output in request order, sort by a position column of
    the caller's.
    """
    requests = requests.withColumn(ENTITY_KEY, F.col(ENTITY_KEY).cast("string"))
    keys = requests.select(ENTITY_KEY).where(F.col(ENTITY_KEY).isNotNull()).distinct()
    answers = keys
    nulls: dict[str, Column] = {}
    now_us = F.lit(micros_of(now))
    for name, features in refs_by_view(refs).items():
        if name not in states:
            raise ValueError(f"unknown feature view {name!r}")
        held = states[name]
        declared = {f: held.view.get_feature(f) for f in features}
        missing = [f for f, spec in declared.items() if spec is None]
        if missing:
            raise ValueError(f"view {name!r} declares no feature {missing}")
        state = held.data
        found = [f for f in features if state is not None and f in state.columns]
        for f in features:
            if f not in found:
                nulls[f"{name}:{f}"] = F.lit(None).cast(declared[f].dtype.spark)
        if not found:
            continue
        cells = state.select(
            ENTITY_KEY,
            *[
                alive(
                    F.col(f"`{f}`"),
                    held.view.ttl_seconds,
                    now_us,
                    epoch_micros(F.col(f"`{f}`.ts"), state.schema[f].dataType["ts"].dataType),
                ).alias(f"{name}:{f}")
                for f in found
            ],
        )
        answers = answers.join(cells, ENTITY_KEY, "left")
    labels = [f"{v}:{f}" for v, fs in refs_by_view(refs).items() for f in fs]
    joined = join_answers(requests, answers, ENTITY_KEY, policy)
    return joined.select(
        *[F.col(f"`{c}`") for c in requests.columns],
        *[nulls[c].alias(c) if c in nulls else F.col(f"`{c}`") for c in labels],
    )


def long_state(held: ViewState) -> DataFrame:
    """State as one row per entity and known feature, values in typed columns."""
    state, view = held.data, held.view
    present = [f for f in view.features if f.name in state.columns]
    cells = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("feature"),
                typed(f"`{f.name}`.value", f.dtype).alias("held"),
                F.col(f"`{f.name}`.ts").alias("ts"),
                F.col(f"`{f.name}`").isNotNull().alias("known"),
            )
            for f in present
        ]
    )
    return (
        state.select(ENTITY_KEY, F.inline(cells))
        .where("known")
        .select(
            F.lit(view.name).alias("feature_view"), ENTITY_KEY, "feature", "held.*", "ts"
        )
    )


def entity_all(states: Mapping[str, ViewState], entity_key: str) -> DataFrame:
    """Everything that is known of one entity, over all views and without TTL."""
    parts = []
    for held in states.values():
        if held.data is not None:
            one = ViewState(held.view, held.data.where(F.col(ENTITY_KEY) == entity_key))
            parts.append(long_state(one))
    return reduce(DataFrame.unionByName, parts)


def freshness(states: Mapping[str, ViewState], now: dt.datetime) -> DataFrame:
    """Age, remaining life and status of every entity in every view."""
    parts = [_freshness(held, now) for held in states.values() if held.data is not None]
    return reduce(DataFrame.unionByName, parts)


def _freshness(held: ViewState, now: dt.datetime) -> DataFrame:
    state, ttl = held.data, held.view.ttl_seconds
    cells = [f for f in held.view.feature_names() if f in state.columns]
    times = [
        epoch_micros(F.col(f"`{f}`.ts"), state.schema[f].dataType["ts"].dataType) for f in cells
    ]
    newest = F.greatest(*times) if len(times) > 1 else times[0]
    known = sum((F.col(f"`{f}`").isNotNull().cast("long") for f in cells), F.lit(0).cast("long"))
    age = round_even((F.lit(micros_of(now)) - newest) / F.lit(float(MICROS)), 1)
    rows = state.select(
        F.lit(held.view.name).alias("feature_view"),
        ENTITY_KEY,
        age.alias("age_seconds"),
        F.lit(ttl).cast("long").alias("ttl_seconds"),
        known.alias("feature_count"),
    ).where(F.col("feature_count") > 0)
    if ttl is None:
        return rows.withColumns(
            {"ttl_remaining_seconds": F.lit(None).cast("double"), "status": F.lit("FRESH")}
        )
    left = F.greatest(F.lit(float(ttl)) - F.col("age_seconds"), F.lit(0.0))
    return rows.withColumn("ttl_remaining_seconds", left).withColumn(
        "status",
        F.when(F.col("age_seconds") > ttl, F.lit("EXPIRED"))
        .when(F.col("ttl_remaining_seconds") < F.lit(ttl * 0.2), F.lit("EXPIRING_SOON"))
        .otherwise(F.lit("FRESH")),
    )


def stalest(fresh: DataFrame, limit: int) -> DataFrame:
    """The entities whose state is oldest, oldest first."""
    return fresh.orderBy(F.desc("age_seconds"), "feature_view", ENTITY_KEY).limit(limit)
