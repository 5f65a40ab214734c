"""Distribution drift between a baseline and a current side, for many features at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numerics import round_even
from tidemark.operators.ranks import interpolated, named_rows, numbers
from tidemark.operators.slicing import SkewPolicy

BASELINE, CURRENT = "baseline", "current"

# The bounds and names of the drift report.
FLOOR_SHARE = 1e-6
MIN_VALUES = 10
MODERATE, SIGNIFICANT = 0.1, 0.2
NORMAL, MODERATE_DRIFT, SIGNIFICANT_DRIFT = "NORMAL", "MODERATE_DRIFT", "SIGNIFICANT_DRIFT"
DRIFT_DETECTED = "DRIFT_DETECTED"
TOO_FEW_VALUES, INCOMPLETE = "TOO_FEW_VALUES", "INCOMPLETE"


def psi(
    values: DataFrame,
    features: Sequence[str] | DataFrame,
    *,
    buckets: int = 10,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Population stability index of every feature.

    ``values`` has ``feature, side, value`` with side ``baseline`` or ``current``. Bucket
    edges are the quantiles of the baseline; repeated edges count once, the outer buckets
    are open, and an empty share counts as ``FLOOR_SHARE``. With fewer than two different
    edges the index is 0. Also gives size and mean of both sides.

    Only the named ``features`` are read, so what is broadcast has one row for each of them. A
    DataFrame with a column ``feature`` may name any number of them; then nothing is broadcast. The values are scanned twice: for the edges, and to place them in buckets.
    """
    values = numbers(values, "value", "feature", features)
    shares = [i / buckets for i in range(buckets + 1)]
    edges = interpolated(
        values.where(F.col("side") == BASELINE).drop("side"),
        "value",
        shares,
        "edges",
        by="feature",
        names=features,
        policy=policy,
    ).select("feature", F.array_distinct("edges").alias("edges"))

    # Inner edges only: below the second edge is bucket 0, from the last but one on the top.
    # Two equal outer edges leave one edge, hence no inner ones.
    inner = [
        f"CASE WHEN {i} < size(edges) - 1 AND value >= get(edges, {i}) THEN 1 ELSE 0 END"
        for i in range(1, buckets)
    ]
    placed = values.join(named_rows(edges, features), "feature").withColumn(
        "bucket", F.expr(" + ".join(["0", *inner]))
    )

    def total(side: str, measure: str) -> Column:
        return F.expr(f"sum(CASE WHEN side = '{side}' THEN {measure} ELSE 0 END)")

    filled = placed.groupBy("feature", "bucket").agg(
        F.expr("max(size(edges))").alias("edge_count"),
        total(BASELINE, "1").alias("base_rows"),
        total(CURRENT, "1").alias("cur_rows"),
        total(BASELINE, "value").alias("base_sum"),
        total(CURRENT, "value").alias("cur_sum"),
    )
    # At most ``buckets`` rows per feature from here on. A bucket with no value on either
    # side does not appear; both shares are the floor there and it adds nothing.
    whole = Window.partitionBy("feature")
    shares = filled.select(
        "*",
        F.sum("base_rows").over(whole).alias("baseline_count"),
        F.sum("cur_rows").over(whole).alias("current_count"),
    )
    base = F.greatest(F.try_divide("base_rows", "baseline_count"), F.lit(FLOOR_SHARE))
    cur = F.greatest(F.try_divide("cur_rows", "current_count"), F.lit(FLOOR_SHARE))
    index = shares.groupBy("feature").agg(
        F.sum((cur - base) * F.log(cur / base)).alias("psi"),
        F.max("edge_count").alias("edge_count"),
        F.max("baseline_count").alias("baseline_count"),
        F.max("current_count").alias("current_count"),
        F.sum("base_sum").alias("base_sum"),
        F.sum("cur_sum").alias("cur_sum"),
    )
    known = (F.col("edge_count") >= 2) & (F.col("current_count") > 0)
    return index.select(
        "feature",
        F.when(known, F.col("psi")).otherwise(F.lit(0.0)).alias("psi"),
        "baseline_count",
        "current_count",
        F.try_divide("base_sum", "baseline_count").alias("baseline_mean"),
        F.try_divide("cur_sum", "current_count").alias("current_mean"),
    )


def drift_report(
    values: DataFrame,
    features: Sequence[str] | DataFrame,
    *,
    buckets: int = 10,
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Index, means, mean shift and status of every feature asked for, by name or in the column
    ``feature`` of a DataFrame of any size.

    A feature with fewer than ``MIN_VALUES`` on a side, also with none, has no index and says so.
    """
    if isinstance(features, DataFrame):
        asked = features = features.select("feature").distinct()
    else:
        asked = values.sparkSession.createDataFrame([(f,) for f in dict.fromkeys(features)], "feature string")
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("baseline_count", "current_count")}
    # One row a feature on both sides.
    found = (
        asked.join(psi(values, features, buckets=buckets, policy=policy), "feature", "left")
        .withColumns(counts)
        .withColumn("enough", F.least("baseline_count", "current_count") >= MIN_VALUES)
        .withColumn("psi", F.when(F.col("enough"), F.col("psi")))
    )
    status = (
        F.when(~F.col("enough"), F.lit(TOO_FEW_VALUES))
        .when(F.col("psi") < MODERATE, F.lit(NORMAL))
        .when(F.col("psi") < SIGNIFICANT, F.lit(MODERATE_DRIFT))
        .otherwise(F.lit(SIGNIFICANT_DRIFT))
    )
    means = found.select(
        "feature",
        round_even(F.col("psi"), 5).alias("psi"),
        round_even(F.col("current_mean"), 4).alias("online_mean"),
        round_even(F.col("baseline_mean"), 4).alias("offline_mean"),
        status.alias("status"),
        "baseline_count",
        "current_count",
    )
    against = F.abs("offline_mean")
    shift = F.abs(F.col("online_mean") - F.col("offline_mean")) / F.when(
        against == 0.0, F.lit(1.0)
    ).otherwise(against)
    return means.withColumn("mean_shift_percent", round_even(shift * 100.0, 2))


def overall_status(report: DataFrame) -> DataFrame:
    """``NORMAL`` if every feature is, also if there is none; ``INCOMPLETE`` if nothing has drifted
    but some feature could not be judged."""
    few = F.count_if(F.col("status") == TOO_FEW_VALUES)
    calm = F.count_if(F.col("status") == NORMAL)
    return report.agg(
        (F.count("*") - few).alias("features_monitored"),
        few.alias("features_unjudged"),
        F.when(calm + few < F.count("*"), F.lit(DRIFT_DETECTED))
        .when(few > 0, F.lit(INCOMPLETE))
        .otherwise(F.lit(NORMAL))
        .alias("overall_status"),
    )
