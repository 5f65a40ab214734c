"""Ordered work on groups of any size.

A window runs each of its groups in one task, so one key that holds a third of all rows
would decide the run time of the job. ``find_splits`` looks for such groups in a sample of
the keys and cuts their order axis (time or value) into slices that are small enough for a
task; ``Splits.assign`` tags rows with their slice. Work on a sliced group is done per
slice, and a small table with one row per slice carries the running state from slice to
slice. Groups below the limit are not sliced and pay nothing but the sample.

A slice that is still too large (a burst) is cut again, level by level. Rows of one group
that share one order value cannot be cut; such an instant becomes a *point*, whose rows
all have the same answer: the state after the instant, looked up from the carry table.

Size of what is broadcast: a group is listed only if it has more than ``rows_per_slice``
rows, and at most the ``max_hot_groups`` largest are listed, so each table has at most
``min(rows / rows_per_slice, max_hot_groups)`` rows, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT = "_hot"
POINT = "_point"
MIN_PARTS = 64
SAMPLED_ROWS = 4096
SEED = 17


@dataclass(frozen=True)
class SkewPolicy:
    """When and how finely groups are cut.

    ``rows_per_slice`` rows is the most one task should order at once. ``spread`` slices
    are made per ``rows_per_slice`` rows, so that uneven slices stay below the limit.
    ``detect=False`` skips the counting job where the caller knows that no group is large.
    """

    rows_per_slice: int = 4_000_000
    max_hot_groups: int = 100_000
    max_levels: int = 8
    spread: int = 4
    detect: bool = True


@dataclass
class Splits:
    """Cut positions of the large groups of one data set."""

    group: list[str]
    order: str
    levels: list[tuple[list[str], DataFrame]] = field(default_factory=list)
    points: DataFrame | None = None

    def __bool__(self) -> bool:
        return bool(self.levels) or self.points is not None

    @property
    def slices(self) -> list[str]:
        return [f"_slice{i}" for i in range(len(self.levels))]

    @property
    def keys(self) -> list[str]:
        """Columns that name one unit of work: the group and its slice."""
        return [*self.group, *self.slices]

    def assign(self, df: DataFrame) -> DataFrame:
        """Add the slice columns, ``_hot`` (in a large group) and ``_point``."""
        hot = F.lit(False)
        for i, (cols, table) in enumerate(self.levels):
            df = df.join(F.broadcast(table), cols, "left")
            df = df.withColumn(f"_slice{i}", F.coalesce(_slice(self.order), F.lit(0)))
            if i == 0:
                hot = F.col("_lo").isNotNull()
                df = df.withColumn(HOT, hot)
            df = df.drop("_lo", "_width", "_parts")
        if not self.levels:
            df = df.withColumn(HOT, hot)
        if self.points is None:
            return df.withColumn(POINT, F.lit(False))
        df = df.join(F.broadcast(self.points), [*self.group, self.order], "left")
        return df.withColumn(POINT, F.coalesce(POINT, F.lit(False))).withColumn(
            HOT, F.col(HOT) | F.col(POINT)
        )


def _slice(order: str) -> Column:
    position = F.floor((F.col(order) - F.col("_lo")) / F.col("_width")).cast("long")
    return F.greatest(F.least(position, F.col("_parts")), F.lit(-1))


def _frequent(
    df: DataFrame, cols: list[str], policy: SkewPolicy, *picks: Column
) -> tuple[list[Row], float]:
    """The largest groups by a sample, and the share of rows in the sample.

    The sample is large enough to hold thousands of rows of any group above the limit. It
    only decides how the work is cut; results never depend on it.
    """
    share = min(1.0, SAMPLED_ROWS / policy.rows_per_slice)
    found = (
        (df.sample(share, seed=SEED) if share < 1.0 else df)
        .groupBy(*cols)
        .agg(F.count("*").alias("_rows"), *picks)
        .where(F.col("_rows") > policy.rows_per_slice * share * (0.5 if share < 1.0 else 1.0))
        .orderBy(F.desc("_rows"), *cols)
        .limit(policy.max_hot_groups)
        .collect()
    )
    return found, share


def find_splits(
    df: DataFrame,
    group: list[str],
    order: str,
    policy: SkewPolicy | None = None,
    size: Column | None = None,
) -> Splits:
    """Find the groups of ``df`` that need slicing along the numeric column ``order``.

    Runs one job over a sample. If that finds large groups, they are counted per slice, and
    slices that are still too large are cut again. ``size`` is an aggregate that measures a
    group in place of its row count; the groups are then few and measured without a sample.
    """
    policy = policy or SkewPolicy()
    splits = Splits(list(group), order)
    if not policy.detect:
        return splits
    wanted = df.select(*group, order).dropna()
    ends = [F.min(order).alias("_lo"), F.max(order).alias("_hi")]
    order_type = wanted.schema[order].dataType
    key_fields = [wanted.schema[c] for c in group]
    whole = isinstance(order_type, T.LongType)
    instants: list[tuple] = []
    cols = list(group)
    for level in range(policy.max_levels):
        share = 1.0
        if level == 0 and size is None and whole:
            found, share = _frequent(wanted, cols, policy, *ends)
        else:
            measure = F.count("*") if size is None else size
            found = (
                wanted.groupBy(*cols)
                .agg(measure.alias("_rows"), *ends)
                .where(F.col("_rows") > policy.rows_per_slice)
                .orderBy(F.desc("_rows"), *cols)
                .limit(policy.max_hot_groups)
                .collect()
            )
        cuts = []
        for row in found:
            low, high, rows = row["_lo"], row["_hi"], row["_rows"] / share
            if low == high and share == 1.0:
                instants.append((*(row[c] for c in group), low))
                continue
            parts = max(policy.spread * math.ceil(rows / policy.rows_per_slice), MIN_PARTS)
            width = (high - low) / parts
            if whole:
                width = max(width, 1.0)
            if 0.0 < width < math.inf:
                cuts.append((*(row[c] for c in cols), low, float(width), parts))
        if not cuts:
            break
        fields = key_fields + [T.StructField(s, T.LongType()) for s in splits.slices]
        fields += [
            T.StructField("_lo", order_type),
            T.StructField("_width", T.DoubleType()),
            T.StructField("_parts", T.LongType()),
        ]
        table = df.sparkSession.createDataFrame(cuts, T.StructType(fields))
        splits.levels.append((list(cols), table))
        wanted = (
            wanted.join(F.broadcast(table), cols)
            .withColumn(f"_slice{level}", _slice(order))
            .drop("_lo", "_width", "_parts")
        )
        cols.append(f"_slice{level}")
    if instants:
        fields = [*key_fields, T.StructField(order, order_type)]
        splits.points = df.sparkSession.createDataFrame(
            instants, T.StructType(fields)
        ).withColumn(POINT, F.lit(True))
    return splits


def spread(df: DataFrame, splits: Splits) -> DataFrame:
    """Rows partitioned by group and slice.

    Said outright, because input that is already partitioned by group alone would satisfy a
    window over group and slice, and the large group would stay in one task.
    """
    return df.repartition(*splits.keys)


def carry(
    hot: DataFrame, splits: Splits, reduce: dict[str, Column], fold: Callable[[str, Window], Column]
) -> DataFrame:
    """State before (``name``) and after (``name + '_after'``) every slice of the hot groups.

    ``reduce`` gives the state of one slice as aggregates, which Spark combines on the map
    side; ``fold(name, window)`` combines the states of the slices in a window frame. The
    result has one row per slice, so even the largest group is a short window here.
    """
    per_slice = hot.groupBy(*splits.keys).agg(*[c.alias(n) for n, c in reduce.items()])
    in_order = Window.partitionBy(*splits.group)
    if splits.slices:
        in_order = in_order.orderBy(*splits.slices)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    after = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return per_slice.select(
        *splits.keys,
        *[fold(n, before).alias(n) for n in reduce],
        *[fold(n, after).alias(f"{n}_after") for n in reduce],
    )


def running_totals(
    df: DataFrame,
    group: list[str],
    order: str,
    totals: dict[str, Column],
    *,
    strict: bool = False,
    policy: SkewPolicy | None = None,
    splits: Splits | None = None,
) -> DataFrame:
    """Add running sums per group over ``order``; rows of equal order share one total.

    ``strict`` leaves out rows of the same order value. ``order`` must be a numeric column
    without nulls (whole numbers if ``strict``) and the summed expressions must not be null.
    ``splits`` may be given where the caller can find them on cheaper data.
    """
    names = list(totals)
    df = df.select("*", *[c.alias(f"_in_{n}") for n, c in totals.items()])
    if splits is None:
        splits = find_splits(df, group, order, policy)
    end = -1 if strict else 0

    def run(data: DataFrame, keys: list[str]) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy(order)
        frame = frame.rangeBetween(Window.unboundedPreceding, end)
        return data.select(
            "*", *[F.coalesce(F.sum(f"_in_{n}").over(frame), F.lit(0)).alias(n) for n in names]
        )

    if not splits:
        return run(df, group).drop(*[f"_in_{n}" for n in names])

    tagged = splits.assign(df)
    state = carry(
        tagged.where(HOT),
        splits,
        {n: F.sum(f"_in_{n}") for n in names},
        lambda n, w: F.sum(n).over(w),
    )
    # The state before a slice joins its window as one more row that sorts first.
    seeds = state.select(
        *splits.keys,
        *[F.coalesce(n, F.lit(0)).cast(df.schema[f"_in_{n}"].dataType).alias(f"_in_{n}") for n in names],
        F.lit(True).alias("_seed"),
    )
    flowing = tagged.where(~F.col(POINT)).withColumn("_seed", F.lit(False))
    done = run(spread(flowing.unionByName(seeds, allowMissingColumns=True), splits), splits.keys)
    done = done.where(~F.col("_seed"))
    if splits.points is not None:
        answer = state.select(
            *splits.keys,
            *[F.coalesce(n if strict else f"{n}_after", F.lit(0)).alias(n) for n in names],
        )
        points = tagged.where(POINT).join(
            F.broadcast(only_points(answer, splits)), splits.keys, "left"
        )
        done = done.unionByName(points, allowMissingColumns=True)
    return done.drop(*splits.slices, HOT, POINT, "_seed", *[f"_in_{n}" for n in names])


def only_points(answer: DataFrame, splits: Splits) -> DataFrame:
    """Rows of a carry table that belong to points: at most one per listed point."""
    where = splits.assign(splits.points.drop(POINT)).select(*splits.keys)
    return answer.join(F.broadcast(where), splits.keys, "left_semi")


def join_answers(
    requests: DataFrame, answers: DataFrame, key: str, policy: SkewPolicy | None = None
) -> DataFrame:
    """Left join of ``requests`` with a table that has one row per key.

    Keys with very many requests are listed by a count, and their answers are broadcast: at
    most one row per listed key. All other requests are joined by a shuffle.
    """
    policy = policy or SkewPolicy()
    popular = None
    if policy.detect:
        found, _ = _frequent(requests.select(key).dropna(), [key], policy)
        if found:
            popular = requests.sparkSession.createDataFrame(
                [(r[key],) for r in found], T.StructType([requests.schema[key]])
            )
    # A missing key has no answer and need not travel.
    absent = requests.where(F.col(key).isNull())
    known = requests.where(F.col(key).isNotNull())
    if popular is None:
        joined = known.join(answers, key, "left")
    else:
        listed = F.broadcast(popular)
        few = F.broadcast(answers.join(listed, key, "left_semi"))
        many = known.join(listed, key, "left_semi").join(few, key, "left")
        rest = known.join(listed, key, "left_anti").join(answers, key, "left")
        joined = many.unionByName(rest)
    return joined.unionByName(absent, allowMissingColumns=True)
