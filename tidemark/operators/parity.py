"""Parity: what was served against what history says, value by value."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numerics import round_even
from tidemark.functions.values import typed
from tidemark.operators.drift import BASELINE, CURRENT
from tidemark.operators.pit import ViewData, point_in_time_join
from tidemark.operators.slicing import SkewPolicy
from tidemark.session import written
from tidemark.sources.logs import newest
from tidemark.specs import ENTITY_KEY, EVENT_TIME, DataType, Ref, refs_by_view

# Fixed value: numbers that differ by no more count as equal.
TOLERANCE = 1e-5

SIDES = ("online", "offline")
PARTS = ("num", "text", "flag")


def parity_checks(
    log: DataFrame,
    views: Mapping[str, ViewData],
    refs: list[str],
    *,
    sample_size: int | None = None,
    tolerance: float = TOLERANCE,
    use_ttl: bool = True,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """One row per logged value of a requested feature, with the value from history.

    ``log`` has ``inference_id, entity_key, event_timestamp, features`` as made by
    ``served_features``. All of it is checked, or on request the newest ``sample_size``
    inferences. The logged values travel through the point-in-time join inside their row, so
    comparing them needs no second join.
    """
    if sample_size is not None:
        log = written(newest(log, sample_size, EVENT_TIME, "inference_id"), "sample")
    labels = [Ref.parse(r).label for r in refs]
    joined = point_in_time_join(log, views, refs, use_ttl=use_ttl, policy=policy)
    dtypes = {
        f"{v}:{f}": views[v].view.get_feature(f).dtype
        for v, fs in refs_by_view(refs).items()
        for f in fs
    }
    pairs = [
        F.struct(
            F.lit(label).alias("feature"),
            F.lit(_kind(dtypes[label])).alias("kind"),
            F.map_contains_key("features", label).alias("logged"),
            F.try_element_at("features", F.lit(label)).alias("online"),
            typed(label, dtypes[label]).alias("offline"),
        )
        for label in dict.fromkeys(labels)
    ]
    logged = joined.select(
        "inference_id", ENTITY_KEY, EVENT_TIME, F.inline(F.array(*pairs))
    ).where("logged")
    return logged.withColumn("matched", same(tolerance)).selectExpr(
        "inference_id",
        ENTITY_KEY,
        EVENT_TIME,
        "feature",
        *[f"{side}.{part} AS {side}_{part}" for side in SIDES for part in PARTS],
        "matched",
    )


def _kind(dtype: DataType) -> str:
    if dtype is DataType.BOOLEAN:
        return "flag"
    return "num" if dtype.numeric else "text"


def same(tolerance: float) -> Column:
    """Whether ``online`` and ``offline`` agree, by the declared ``kind`` of the feature.

    Nulls match each other and nothing else. Booleans also match where one side kept them
    as numbers.
    """
    known = {
        side: f"""CASE kind WHEN 'num' THEN {side}.num IS NOT NULL
                            WHEN 'flag' THEN coalesce({side}.flag, {side}.num <> 0) IS NOT NULL
                            ELSE {side}.text IS NOT NULL END"""
        for side in SIDES
    }
    left, right = known.values()
    return F.expr(
        f"""CASE WHEN NOT ({left}) AND NOT ({right}) THEN TRUE
                 WHEN NOT ({left}) OR NOT ({right}) THEN FALSE
                 WHEN kind = 'num' THEN abs(online.num - offline.num) <= {tolerance!r}D
                 WHEN kind = 'flag' THEN coalesce(online.flag, online.num <> 0)
                                       = coalesce(offline.flag, offline.num <> 0)
                 ELSE online.text = offline.text END"""
    )


def summary(checks: DataFrame) -> DataFrame:
    """Totals and rates; without any check the skew is 0 % and the parity 100 %."""
    total, good = F.col("total_checks"), F.col("matched_features")
    counted = checks.agg(
        F.count("*").alias("total_checks"), F.count_if("matched").alias("matched_features")
    )

    def rate(part: Column, empty: float) -> Column:
        share = round_even(part / total * 100.0, 4)
        return F.when(total > 0, share).otherwise(F.lit(empty))

    return counted.select(
        "total_checks",
        "matched_features",
        (total - good).alias("mismatched_features"),
        rate(total - good, 0.0).alias("skew_rate_percent"),
        rate(good, 100.0).alias("parity_rate_percent"),
    )


def mismatches(checks: DataFrame, limit: int | None = None) -> DataFrame:
    """All values that differ, or the first ``limit``, oldest inference first."""
    found = checks.where(~F.col("matched")).drop("matched")
    if limit is None:
        return found
    return found.orderBy(EVENT_TIME, "inference_id", "feature").limit(limit)


def drift_values(checks: DataFrame) -> DataFrame:
    """Numeric values of both sides as input for the drift report; history is the baseline."""
    sides = F.array(
        F.struct(F.lit(BASELINE).alias("side"), F.col("offline_num").alias("value")),
        F.struct(F.lit(CURRENT).alias("side"), F.col("online_num").alias("value")),
    )
    return checks.select("feature", F.inline(sides)).where(F.col("value").isNotNull())
