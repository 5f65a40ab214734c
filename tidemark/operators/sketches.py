"""Daily sketches of features and keys, merged over any range of days without a scan of history.

A KLL sketch per feature and day answers quantiles, a theta sketch per view and day counts distinct
entities and their overlap between views. Both are built by one aggregation with map-side combine: a
task sends one sketch per day and column, a few kilobytes each, whatever its rows. Merging sketches
is exact in what it promises: the error bound of the parts is that of the whole.

Quantiles are off by at most ``rank_error(k)`` of the ranks in 99 of 100 cases; below ``k`` values they
are exact. Distinct counts are exact up to ``2 ** log_entries`` keys a slot; beyond, the relative standard error
is ``1 / sqrt(slots * 2 ** log_entries)``. With one slot a sketch is a few kilobytes whatever the keys; with
``slots_for`` the counts are exact, and the sketches of a day hold 8 bytes for each of its keys, dealt by slot.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.specs import ENTITY_KEY, EVENT_TIME

DAY = "day"
KLL_K, LOG_ENTRIES = 200, 12


def rank_error(k: int = KLL_K) -> float:
    """Normalised rank error of a single quantile at 99 % confidence (published fit for KLL)."""
    return 2.296 / k**0.9021


def value_sketches(rows: DataFrame, features: Sequence[str], k: int = KLL_K, event_time: str = EVENT_TIME) -> DataFrame:
    """``day``, ``feature``, ``n``, ``sketch`` for numeric features. Nulls and NaN don't count; a day on which
    a feature has no value has no row; rows without a time count under a null day."""

    def number(name: str):
        value = F.col(f"`{name}`").cast("double")
        return F.when(~F.isnan(value), value)

    per_day = rows.groupBy(F.to_date(event_time).alias(DAY)).agg(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.count(number(name)).alias("n"),
                F.kll_sketch_agg_double(number(name), F.lit(k)).alias("sketch"),
            ).alias(f"s{i}")
            for i, name in enumerate(features)
        ]
    )
    cells = F.array(*[F.col(f"s{i}") for i in range(len(features))])
    return per_day.select(DAY, F.inline(cells)).where(F.col("n") > 0)


def between(sketches: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sketches of the days from ``since`` to ``until``, both included."""
    if since is not None:
        sketches = sketches.where(F.col(DAY) >= F.lit(since).cast("date"))
    if until is not None:
        sketches = sketches.where(F.col(DAY) <= F.lit(until).cast("date"))
    return sketches


def sketched_quantiles(sketches: DataFrame, shares: Sequence[float], k: int = KLL_K) -> DataFrame:
    """``feature``, ``n``, ``share``, ``value`` over all days of ``sketches``."""
    merged = sketches.groupBy("feature").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )
    # The share must be a literal, so each has its own expression.
    points = [
        F.struct(
            F.lit(float(p)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")
        )
        for p in shares
    ]
    return merged.select("feature", "n", F.inline(F.array(*points)))


def _keys(histories: Mapping[str, DataFrame], event_time: str) -> DataFrame:
    parts = [
        rows.where(F.col(ENTITY_KEY).isNotNull()).select(
            F.lit(name).alias("feature_view"),
            F.to_date(event_time).alias(DAY),
            F.col(ENTITY_KEY).cast("string").alias(ENTITY_KEY),
        )
        for name, rows in histories.items()
    ]
    if not parts:
        raise ValueError("no views")
    return reduce(DataFrame.union, parts)


def slots_for(histories: Mapping[str, DataFrame], log_entries: int = LOG_ENTRIES, event_time: str = EVENT_TIME) -> int:
    """So many slots that the counts of ``key_overlap`` are exact: on average a quarter of the keys that a
    sketch holds exactly fall in a slot."""
    keys = _keys(histories, event_time).agg(F.approx_count_distinct(ENTITY_KEY)).first()[0]
    return max(1, math.ceil(4 * keys / 2**log_entries))


def key_sketches(
    histories: Mapping[str, DataFrame],
    log_entries: int = LOG_ENTRIES,
    event_time: str = EVENT_TIME,
    slots: int = 1,
) -> DataFrame:
    """``feature_view``, ``day``, ``slot``, ``sketch`` of the entities with a row on that day.

    A key belongs to one of ``slots`` slots by its hash, each with a sketch of its own. Sketches that are to
    be merged must have the same number of slots.
    """
    slot = F.pmod(F.xxhash64(ENTITY_KEY), F.lit(slots)).cast("int").alias("slot")
    whole = _keys(histories, event_time)
    return whole.groupBy("feature_view", DAY, slot).agg(F.theta_sketch_agg(ENTITY_KEY, log_entries).alias("sketch"))


def key_overlap(sketches: DataFrame, log_entries: int = LOG_ENTRIES) -> DataFrame:
    """``view_a``, ``view_b``, ``keys_a``, ``keys_b``, ``keys_both``, ``keys_any`` of each two views over all
    days of ``sketches``; one row per view and slot stands behind the pairs, not its keys."""
    merged = sketches.groupBy("feature_view", "slot").agg(F.theta_union_agg("sketch", log_entries).alias("s"))
    n = F.theta_sketch_estimate
    totals = merged.groupBy("feature_view").agg(F.sum(n("s")).alias("keys"))
    a = merged.select("slot", F.col("feature_view").alias("view_a"), F.col("s").alias("a"))
    b = merged.select("slot", F.col("feature_view").alias("view_b"), F.col("s").alias("b"))
    # A slot that one of the views lacks has nothing in common.
    common = (
        a.join(b, "slot")
        .where("view_a < view_b")
        .groupBy("view_a", "view_b")
        .agg(
            F.sum(n(F.theta_intersection("a", "b"))).alias("both"),
            F.sum(n("a") + n("b") - n(F.theta_union("a", "b", log_entries))).alias("twice"),
        )
    )
    of_a = totals.select(F.col("feature_view").alias("view_a"), F.col("keys").alias("keys_a"))
    of_b = totals.select(F.col("feature_view").alias("view_b"), F.col("keys").alias("keys_b"))
    return (
        of_a.join(of_b, F.col("view_a") < F.col("view_b"))
        .join(common, ["view_a", "view_b"], "left")
        .select(
            "view_a",
            "view_b",
            "keys_a",
            "keys_b",
            F.coalesce("both", F.lit(0)).alias("keys_both"),
            (F.col("keys_a") + F.col("keys_b") - F.coalesce("twice", F.lit(0))).alias("keys_any"),
        )
    )
