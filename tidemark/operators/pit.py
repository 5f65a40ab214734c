"""Point-in-time join: the features known at each observation, for many views at once.

All views and the observations go into one union, so that any number of views costs one
shuffle and one sort by entity and time. In that order the newest feature row so far is a
running ``last``; only observation rows are kept. No row is ever paired with another, so
the work is the size of the input, not of observations times history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import entity_key
from tidemark.functions.numerics import MICROS, epoch_micros, moment
from tidemark.operators.slicing import (
    HOT,
    POINT,
    SkewPolicy,
    carry,
    find_splits,
    only_points,
    running_totals,
    spread,
)
from tidemark.session import written
from tidemark.specs import (
    CREATED_TIME,
    ENTITY_KEY,
    EVENT_DATE,
    EVENT_TIME,
    Entity,
    FeatureView,
    refs_by_view,
)

_AT = "_at"
_OBS = "_obs"
_ROW = "_row"


@dataclass(frozen=True)
class ViewData:
    """A feature view and its history; ``data=None`` stands for a view without data."""

    view: FeatureView
    data: DataFrame | None


@dataclass(frozen=True)
class _Pack:
    """Columns that are remembered together: a whole row, or one feature of it."""

    name: str
    view: FeatureView
    features: tuple[str, ...]


def point_in_time_join(
    spine: DataFrame,
    views: Mapping[str, ViewData],
    refs: list[str],
    *,
    use_ttl: bool = True,
    per_feature: bool = False,
    as_known: bool = False,
    prune: bool = True,
    buckets: int | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Add a column ``view:feature`` to ``spine`` for every reference.

    An observation gets the newest feature row with the same key and a time not after its
    own. A null in that row stays null, unless ``per_feature`` asks for the newest non-null
    value of each feature. Features older than the view's TTL become null; an age of exactly
    the TTL is kept. Ties on time go to the newest created time, then to ``view.tie``.
    Observations without key or time, and views without data, get nulls.

    ``as_known`` also asks that the row had been created by the observation's time: a row that came
    late is not seen before it came, however early its own time is. Rows are then swept in the order
    in which they became available, and the newest so far is a running maximum. Without a created
    time a row is known from its own time on.

    ``prune`` limits the history scans to the times that the spine can reach. ``buckets`` says
    that all histories are tables bucketed by key into that many buckets: the spine is then
    partitioned alike and is the only thing shuffled, the histories stay where they are.
    """
    wanted = refs_by_view(refs)
    _check(views, wanted)
    spine = spine.withColumn(ENTITY_KEY, F.col(ENTITY_KEY).cast("string"))
    if isinstance(spine.schema[EVENT_TIME].dataType, T.StringType):
        spine = spine.withColumn(EVENT_TIME, F.to_timestamp(EVENT_TIME))

    span = _Span.of(spine) if prune else None
    packs: list[_Pack] = []
    inputs: list[DataFrame] = []
    for name, features in wanted.items():
        held = views[name]
        if held.data is None:
            continue
        groups = [(f,) for f in features] if per_feature else [tuple(features)]
        made = [_Pack(f"_p{len(packs) + i}", held.view, g) for i, g in enumerate(groups)]
        packs += made
        data = _reachable(held, span, use_ttl) if span else held.data
        inputs.append(_feature_side(data, held.view, made, per_feature, as_known))

    lost = F.col(ENTITY_KEY).isNull() | F.col(EVENT_TIME).isNull()
    if packs:
        observations = _observation_side(spine.where(~lost))
        if buckets is not None:
            observations = observations.repartition(buckets, ENTITY_KEY)
        joined = _as_of(observations, inputs, packs, as_known, policy)
        # Observations that match nothing stay out of the shuffle: as one null key they
        # could be a large group.
        unmatched = _observation_side(spine.where(lost)).select(_OBS, _AT)
        joined = joined.unionByName(unmatched, allowMissingColumns=True)
    else:
        joined = _observation_side(spine)
    return _unpack(joined, spine.columns, views, wanted, packs, use_ttl)


def _check(views: Mapping[str, ViewData], wanted: dict[str, list[str]]) -> None:
    for name, features in wanted.items():
        if name not in views:
            raise ValueError(f"unknown feature view {name!r}")
        held = views[name]
        for feature in features:
            if held.view.get_feature(feature) is None:
                raise ValueError(f"view {name!r} declares no feature {feature!r}")
            if held.data is not None and feature not in held.data.columns:
                raise ValueError(f"history of view {name!r} has no column {feature!r}")


def _reachable(held: ViewData, span: _Span, use_ttl: bool) -> DataFrame:
    """History rows that some observation may see.

    The spine's time range is read once and enters the scans as literals, so that row
    groups and date partitions outside it are not read.
    """
    data, at = held.data, F.col(EVENT_TIME)
    if span.first is None or data.schema[EVENT_TIME].dataType != span.dtype:
        return data
    # A day of slack on dates, whose zone is the session's.
    day, date = dt.timedelta(days=1), F.col(EVENT_DATE)
    dated = EVENT_DATE in data.columns
    data = data.where(at <= moment(span.last, span.dtype))
    if dated:
        data = data.where(date <= F.lit((_EPOCH + _us(span.last) + day).date()))
    if use_ttl and held.view.ttl_seconds is not None:
        oldest = span.first - held.view.ttl_seconds * MICROS
        data = data.where(at >= moment(oldest, span.dtype))
        if dated:
            data = data.where(date >= F.lit((_EPOCH + _us(oldest) - day).date()))
    return data


_EPOCH = dt.datetime(1970, 1, 1)


def _us(micros: int) -> dt.timedelta:
    return dt.timedelta(microseconds=micros)


@dataclass(frozen=True)
class _Span:
    """First and last time of the observations, in microseconds since 1970."""

    first: int | None
    last: int | None
    dtype: T.DataType

    @classmethod
    def of(cls, spine: DataFrame) -> _Span:
        dtype = spine.schema[EVENT_TIME].dataType
        ends = spine.agg(F.min(EVENT_TIME).alias("lo"), F.max(EVENT_TIME).alias("hi"))
        found = ends.select(
            epoch_micros(F.col("lo"), dtype), epoch_micros(F.col("hi"), dtype)
        ).first()
        return cls(found[0], found[1], dtype)


def _observation_side(spine: DataFrame) -> DataFrame:
    """Observations, each packed in one struct."""
    at = epoch_micros(F.col(EVENT_TIME), spine.schema[EVENT_TIME].dataType)
    whole = [F.col(f"`{c}`") for c in spine.columns]
    return spine.select(
        ENTITY_KEY, at.alias(_AT), F.lit(1).alias("_side"), F.struct(*whole).alias(_OBS)
    )


def _feature_side(
    data: DataFrame, view: FeatureView, packs: list[_Pack], per_feature: bool, as_known: bool
) -> DataFrame:
    at = epoch_micros(F.col(EVENT_TIME), data.schema[EVENT_TIME].dataType)
    rows = data.where(F.col(ENTITY_KEY).isNotNull() & F.col(EVENT_TIME).isNotNull())
    ranks = {}
    if CREATED_TIME in data.columns:
        made = epoch_micros(F.col(CREATED_TIME), data.schema[CREATED_TIME].dataType)
        ranks["_created"] = made
    if view.tie:
        ranks["_tie"] = F.col(view.tie).cast("long")

    # Before all other fields, so that the order of packs is that of their rows.
    rank = F.struct(at.alias("at"), *[c.alias(n) for n, c in ranks.items()])

    def pack(p: _Pack) -> Column:
        first = [rank.alias("rank")] if as_known else []
        whole = F.struct(*first, at.alias("at"), *[F.col(f"`{f}`") for f in p.features])
        return F.when(F.col(f"`{p.features[0]}`").isNotNull(), whole) if per_feature else whole

    # Nulls are passed over.
    available = F.greatest(at, ranks["_created"]) if as_known and "_created" in ranks else at
    return rows.select(
        F.col(ENTITY_KEY).cast("string").alias(ENTITY_KEY),
        available.alias(_AT),
        F.lit(0).alias("_side"),
        *[c.alias(n) for n, c in ranks.items()],
        *[pack(p).alias(p.name) for p in packs],
    )


def _as_of(
    observations: DataFrame,
    inputs: list[DataFrame],
    packs: list[_Pack],
    as_known: bool,
    policy: SkewPolicy | None,
) -> DataFrame:
    names = [p.name for p in packs]

    def newest_so_far(name: str, window: Window) -> Column:
        if as_known:
            return F.max_by(name, F.col(f"{name}.rank")).over(window)
        return F.last(name, ignorenulls=True).over(window)

    merged = observations
    for side in inputs:
        merged = merged.unionByName(side, allowMissingColumns=True)
    splits = find_splits(merged, [ENTITY_KEY], _AT, policy)
    ranks = [c for c in ("_created", "_tie") if c in merged.columns]

    def run(rows: DataFrame, keys: list[str]) -> DataFrame:
        so_far = (
            Window.partitionBy(*keys)
            .orderBy(_AT, "_side", *ranks)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        newest = [newest_so_far(n, so_far).alias(n) for n in names]
        return rows.select("_side", _OBS, _AT, *newest).where(F.col("_side") == 1).drop("_side")

    if not splits:
        return run(merged, [ENTITY_KEY])

    tagged = splits.assign(merged)
    # The order is null where the pack is, and max_by passes over rows with a null order.
    rank = F.struct(_AT, *ranks)
    state = carry(
        tagged.where(HOT),
        splits,
        {n: F.max_by(n, F.col(f"{n}.rank") if as_known else F.when(F.col(n).isNotNull(), rank)) for n in names},
        newest_so_far,
    )
    seeds = state.select(*splits.keys, *names, F.lit(0).alias("_side"))
    flowing = tagged.where(~F.col(POINT)).drop(HOT, POINT)
    done = run(spread(flowing.unionByName(seeds, allowMissingColumns=True), splits), splits.keys)
    if splits.points is not None:
        answer = only_points(
            state.select(*splits.keys, *[F.col(f"{n}_after").alias(n) for n in names]), splits
        )
        points = tagged.where(F.col(POINT) & (F.col("_side") == 1)).select(*splits.keys, _OBS, _AT)
        points = points.join(F.broadcast(answer), splits.keys, "left").select(_OBS, _AT, *names)
        done = done.unionByName(points)
    return done


def _unpack(
    joined: DataFrame,
    spine_columns: list[str],
    views: Mapping[str, ViewData],
    wanted: dict[str, list[str]],
    packs: list[_Pack],
    use_ttl: bool,
) -> DataFrame:
    by_feature = {(p.view.name, f): p for p in packs for f in p.features}
    out = [F.col(f"{_OBS}.`{c}`").alias(c) for c in spine_columns]
    for name, features in wanted.items():
        view = views[name].view
        for feature in features:
            label = f"{name}:{feature}"
            pack = by_feature.get((name, feature))
            if pack is None:
                out.append(F.lit(None).cast(view.get_feature(feature).dtype.spark).alias(label))
                continue
            value = F.col(f"{pack.name}.`{feature}`")
            if use_ttl and view.ttl_seconds is not None:
                age = F.col(_AT) - F.col(f"{pack.name}.at")
                value = F.when(age <= view.ttl_seconds * MICROS, value)
            out.append(value.alias(label))
    return joined.select(*out)


def join_entities(
    spine: DataFrame,
    views: Mapping[str, ViewData],
    refs: list[str],
    entities: Mapping[str, Entity],
    **options: Any,
) -> DataFrame:
    """Features of several entities for a spine that has the join keys of each.

    Every observation goes out once per entity, with the entity's name before its key, and so do the
    histories: one point-in-time join serves all. What an observation finds is put together again
    by a row number, which is written with the spine, so that it is the same for all its copies. Takes the
    options of ``point_in_time_join``; an observation without an entity's key gets nulls for it.
    """
    wanted = refs_by_view(refs)
    _check(views, wanted)
    names = list(dict.fromkeys(views[n].view.entity_name for n in wanted))
    missing = [n for n in names if n not in entities]
    if missing:
        raise ValueError(f"unknown entities {missing}")
    at = spine.schema[EVENT_TIME].dataType
    if isinstance(at, T.StringType):
        spine = spine.withColumn(EVENT_TIME, F.to_timestamp(EVENT_TIME))
    numbered = written(spine.withColumn(_ROW, F.monotonically_increasing_id()), "spine")

    def of(entity: str, key: Column) -> Column:
        return F.concat(F.lit(f"{entity}:"), key).alias(ENTITY_KEY)

    keys = F.array(*[of(n, entity_key(entities[n].join_keys)) for n in names])
    whole = F.struct(*[F.col(f"`{c}`") for c in spine.columns])
    out = numbered.select(_ROW, EVENT_TIME, whole.alias("_whole"), F.posexplode(keys).alias("_which", ENTITY_KEY))
    # The observation itself travels once.
    out = out.select(_ROW, EVENT_TIME, ENTITY_KEY, F.when(F.col("_which") == 0, F.col("_whole")).alias("_whole"))
    prefixed = {
        n: ViewData(v.view, None if v.data is None else v.data.withColumn(ENTITY_KEY, of(v.view.entity_name, F.col(ENTITY_KEY).cast("string"))))
        for n, v in views.items()
        if n in wanted
    }
    joined = point_in_time_join(out, prefixed, refs, **options)
    labels = [f"{n}:{f}" for n, features in wanted.items() for f in features]
    # At most one row of an observation has a value of a view.
    made = joined.groupBy(_ROW).agg(
        F.first("_whole", ignorenulls=True).alias("_whole"),
        *[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in labels],
    )
    return made.select("_whole.*", *[F.col(f"`{c}`") for c in labels])


def time_travel(
    timeline: DataFrame,
    views: Mapping[str, ViewData],
    refs: list[str],
    *,
    per: list[str] | None = None,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """For every event of a timeline, the features known then and the count of later events.

    ``hidden_updates`` counts the events of the same entity at a strictly later time: those
    that must not leak into a snapshot taken at this one. Works on one timeline or on those
    of all entities at once.
    """
    at = epoch_micros(F.col(EVENT_TIME), timeline.schema[EVENT_TIME].dataType)
    backwards = timeline.withColumn("_back", -at)
    counted = running_totals(
        backwards,
        per or [ENTITY_KEY],
        "_back",
        {"hidden_updates": F.lit(1).cast("long")},
        strict=True,
        policy=policy,
    ).drop("_back")
    return point_in_time_join(counted, views, refs, policy=policy)
