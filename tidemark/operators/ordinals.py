"""Gapless row numbers of tables of any size.

A window over a whole table runs in one task. Here each partition numbers its own rows, the rows of
every partition are counted, and a running sum over those counts, one row a partition, says where each
partition begins. No task holds more than one partition.
"""

from __future__ import annotations

from collections.abc import Mapping
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.latest import ViewState, lookup
from tidemark.operators.slicing import SkewPolicy
from tidemark.session import written

# ``monotonically_increasing_id`` holds the row's place in its partition in its lowest 33 bits.
_PLACE_BITS = 33
_ID, _PART, _PLACE, _FIRST, _SPREAD = "_id", "_part", "_place", "_first", "_spread"


def row_numbers(
    df: DataFrame, *order: str | Column, name: str = "row_no", first: int = 0, path: str | None = None
) -> DataFrame:
    """``df`` with a row number in ``name``, gapless from ``first``.

    With ``order`` the numbers follow it (nulls as Spark sorts them); rows equal in it get neighbouring
    numbers in any order. Many such rows are dealt over partitions, not put into one. Without ``order``
    the numbers follow the order in which ``df`` is read, and nothing is shuffled. The numbers are settled
    when this returns: rows are written once, to ``path`` or the shared working folder. An existing column
    ``name`` is an error.
    """
    if name in df.columns:
        raise ValueError(f"column {name!r} is there already")
    keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    if keys:
        # The hash of the place in the input cuts rows of one key; it follows the keys, so order stays.
        spread = F.xxhash64(F.monotonically_increasing_id())
        ranged = df.withColumn(_SPREAD, spread).repartitionByRange(*keys, F.col(_SPREAD))
        df = ranged.sortWithinPartitions(*keys, F.col(_SPREAD)).drop(_SPREAD)
    held = written(df.withColumn(_ID, F.monotonically_increasing_id()), "row-numbers", path)
    placed = held.withColumns(
        {
            _PART: F.shiftright(_ID, _PLACE_BITS),
            _PLACE: F.col(_ID).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)),
        }
    )
    sizes = placed.groupBy(_PART).agg(F.count("*").alias("n"))
    # One row a partition of the written table, as many as it had tasks.
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(_PART, (F.coalesce(F.sum("n").over(before), F.lit(0)) + first).alias(_FIRST))
    numbered = placed.join(F.broadcast(starts), _PART)
    return numbered.withColumn(name, F.col(_FIRST) + F.col(_PLACE)).drop(_ID, _PART, _PLACE, _FIRST)


def lookup_in_order(
    requests: DataFrame,
    states: Mapping[str, ViewState],
    refs: list[str],
    now: dt.datetime,
    *order: str | Column,
    name: str = "row_no",
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """``lookup`` with the answers in the order of the requests: by ``order``, or as they are read.

    ``name`` holds the place of the request, from 0. The answers come back sorted by it.
    """
    numbered = row_numbers(requests, *order, name=name)
    return lookup(numbered, states, refs, now, policy).orderBy(name)
