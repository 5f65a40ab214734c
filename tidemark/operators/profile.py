"""Distribution summary of a measured column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numerics import round_even
from tidemark.operators.ranks import nearest_rank
from tidemark.operators.slicing import SkewPolicy

# Reported percentiles, and histogram edges with their labels.
PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99, "p999": 0.999}
EDGES = (0.1, 0.25, 0.5, 1.0, 2.0)
LABELS = ("< 0.1ms", "0.1 - 0.25ms", "0.25 - 0.5ms", "0.5 - 1.0ms", "1.0 - 2.0ms", "> 2.0ms")


def percentiles(
    df: DataFrame, value: str, *, digits: int = 4, policy: SkewPolicy | None = None
) -> DataFrame:
    """Nearest-rank percentiles in one row."""
    found = nearest_rank(df, value, PERCENTILES, policy=policy)
    return found.select(*[round_even(F.col(p), digits).alias(p) for p in PERCENTILES])


def basics(df: DataFrame, value: str, *, at_us: Column | None = None, digits: int = 4) -> DataFrame:
    """Count, extremes and mean, and rows per second if ``at_us`` gives the time in micros.

    The rate counts over the span of the times, at least a millisecond.
    """
    number = F.col(value).cast("double")
    measured = df.where(number.isNotNull() & ~F.isnan(number))
    picks = [
        F.count("*").alias("count"),
        round_even(F.min(number), digits).alias("min"),
        round_even(F.max(number), digits).alias("max"),
        round_even(F.avg(number), digits).alias("avg"),
    ]
    if at_us is not None:
        span = F.greatest((F.max(at_us) - F.min(at_us)) / F.lit(1e6), F.lit(0.001))
        picks.append(round_even(F.count("*") / span, 2).alias("rate_per_sec"))
    return measured.agg(*picks)


def histogram(
    df: DataFrame,
    value: str,
    edges: tuple[float, ...] = EDGES,
    labels: tuple[str, ...] = LABELS,
) -> DataFrame:
    """Rows per bucket; bucket ``i`` is ``[edge i-1, edge i)``, and empty buckets show 0.

    One conditional count per bucket in a single aggregation, turned into rows afterwards.
    """
    number = F.col(value).cast("double")
    measured = df.where(number.isNotNull() & ~F.isnan(number))
    bounds = [None, *edges, None]
    counts = []
    for low, high in zip(bounds, bounds[1:]):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (number >= low)
        if high is not None:
            inside = inside & (number < high)
        counts.append(F.count_if(inside))
    rows = [
        F.struct(F.lit(i).alias("bucket_no"), F.lit(label).alias("bucket"), n.alias("row_count"))
        for i, (label, n) in enumerate(zip(labels, counts))
    ]
    return measured.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
