"""Exact order statistics of columns of any size.

Equal values are counted first, so the shuffle carries distinct values and not rows. A
running count over them in value order, sliced where a group is large, gives each value
the ranks it covers; the values at the wanted ranks are picked by one small aggregation.
No task holds a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.slicing import SkewPolicy, find_splits, running_totals

SIZE = "n"
ALL = "_all"


def named_rows(rows: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of which each group has one: broadcast for groups named one by one, for the groups of a
    DataFrame, of which there may be any number, as they are."""
    return rows if isinstance(names, DataFrame) else F.broadcast(rows)


def numbers(df: DataFrame, value: str, by: str | None, names: Sequence[str] | DataFrame) -> DataFrame:
    """The measured values as doubles, without nulls and NaN, for the named groups."""
    # Adding zero makes -0.0 and 0.0 one value.
    number = F.col(value).cast("double") + F.lit(0.0)
    group = F.lit(0).alias(ALL)
    if by is not None:
        if isinstance(names, DataFrame):
            df = df.join(names.select(by), by, "left_semi")
        else:
            df = df.where(F.col(by).isin(list(names)))
        group = F.col(by)
    rest = [c for c in df.columns if c not in (by, value)]
    return df.select(group, *rest, number.alias(value)).where(
        F.col(value).isNotNull() & ~F.isnan(value)
    )


def _positions(
    values: DataFrame, one: str, value: str, policy: SkewPolicy | None, names: Sequence[str] | DataFrame
) -> DataFrame:
    """Distinct values, the zero-based ranks ``first .. last`` they cover, and group size."""
    # Only the number of distinct values matters, and a sketch finds that without a shuffle.
    splits = find_splits(values, [one], value, policy, size=F.approx_count_distinct(value))
    counts = values.groupBy(one, value).agg(F.count("*").alias("rows"))
    ranked = running_totals(counts, [one], value, {"upto": F.col("rows")}, splits=splits)
    # One row per group; Spark shuffles the counts once for both uses.
    sizes = counts.groupBy(one).agg(F.sum("rows").alias(SIZE))
    return ranked.join(named_rows(sizes, names), one).select(
        one,
        value,
        SIZE,
        (F.col("upto") - F.col("rows")).alias("first"),
        (F.col("upto") - 1).alias("last"),
    )


def _at(rank: str, value: str) -> Column:
    """The value that covers a rank."""
    return F.expr(f"max(CASE WHEN first <= {rank} AND {rank} <= last THEN `{value}` END)")


def nearest_rank(
    df: DataFrame,
    value: str,
    shares: dict[str, float],
    *,
    by: str | None = None,
    names: Sequence[str] | DataFrame = (),
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """For each share ``p`` the value at rank ``ceil(p * n)``, the first rank being 1.

    One row, or one per group ``names`` of the column ``by``.
    """
    one = by or ALL
    placed = _positions(numbers(df, value, by, names), one, value, policy, names)

    def rank(p: float) -> str:
        return f"least(greatest(cast(ceil({p}D * {SIZE}) AS long) - 1, 0), {SIZE} - 1)"

    picks = [_at(rank(p), value).alias(name) for name, p in shares.items()]
    return placed.groupBy(one).agg(*picks).drop(ALL)


def interpolated(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    name: str,
    *,
    by: str | None = None,
    names: Sequence[str] | DataFrame = (),
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """An array with the linearly interpolated quantile for each share."""
    one = by or ALL
    placed = _positions(numbers(df, value, by, names), one, value, policy, names)
    picks = [F.max(SIZE).alias(SIZE)]
    for i, p in enumerate(shares):
        below = f"cast(floor(({SIZE} - 1) * {p}D) AS long)"
        picks.append(_at(below, value).alias(f"_lo{i}"))
        picks.append(_at(f"least({below} + 1, {SIZE} - 1)", value).alias(f"_hi{i}"))
    picked = placed.groupBy(one).agg(*picks)

    def between(i: int, p: float) -> str:
        # From the nearer end, so that both ends come out exactly.
        part = f"(({SIZE} - 1) * {p}D - floor(({SIZE} - 1) * {p}D))"
        gap = f"(_hi{i} - _lo{i})"
        return (
            f"CASE WHEN {part} < 0.5D THEN _lo{i} + {gap} * {part} "
            f"ELSE _hi{i} - {gap} * (1D - {part}) END"
        )

    quantiles = F.expr(f"array({', '.join(between(i, p) for i, p in enumerate(shares))})")
    return picked.select(one, SIZE, quantiles.alias(name)).drop(ALL)
