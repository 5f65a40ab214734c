"""A history laid out on a grid of key hash and month, for access by one key or by some days.

Folders ``cells=/key_cell=/month=`` are partitions, so a query for a key reads one cell of each month and a
query for days reads their months, whatever else the table holds; inside a folder rows lie by key and
time, and Bloom filters of the keys let a scan skip row groups. A cell that a very large key fills is
cut into several files. ``key_cells`` is stored as a partition itself, so grids of different fineness are read
alike and nothing has to be remembered.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import micros_of, moment
from tidemark.sources.batches import BatchFolder
from tidemark.sources.history import HistoryTable, timeline
from tidemark.specs import BATCH, ENTITY_KEY, EVENT_DATE, EVENT_TIME, FeatureView

CELLS, KEY_CELL, MONTH = "cells", "key_cell", "month"
# Rows that a file should hold, and the most key cells a month is cut into.
ROWS_PER_FILE, MOST_CELLS = 2_000_000, 4_096


def _cell(key: Column, cells: Column) -> Column:
    return F.pmod(F.xxhash64(key), cells).cast("int")


@dataclass(frozen=True)
class GridTable:
    """The grid of one view's history: a snapshot that ``refresh`` replaces as a whole."""

    spark: SparkSession
    path: str
    view: FeatureView
    time_type: T.DataType = T.TimestampType()

    @property
    def folder(self) -> BatchFolder:
        return BatchFolder(self.spark, self.path)

    def refresh(self, history: HistoryTable, key_cells: int | None = None) -> None:
        """Lay the present history out anew. By default a month of average size gives files of
        ``ROWS_PER_FILE`` rows; one look at a date column finds the sizes."""
        replaced = self.folder.seen().visible
        rows = history.read().withColumn(MONTH, F.trunc(EVENT_DATE, "month"))
        if key_cells is None:
            # One row.
            size = rows.agg(F.count("*").alias("n"), F.count_distinct(MONTH).alias("months")).first()
            key_cells = min(max(1, size.n // (ROWS_PER_FILE * max(size.months, 1))), MOST_CELLS)
        if key_cells < 1:
            raise ValueError("key_cells must be positive")
        rows = rows.withColumn(CELLS, F.lit(key_cells)).withColumn(KEY_CELL, _cell(F.col(ENTITY_KEY), F.col(CELLS)))
        output = self.folder.output()
        (
            rows.hint("rebalance", KEY_CELL, MONTH)
            .sortWithinPartitions(KEY_CELL, MONTH, ENTITY_KEY, EVENT_TIME)
            .write.option(f"parquet.bloom.filter.enabled#{ENTITY_KEY}", "true")
            .partitionBy(CELLS, KEY_CELL, MONTH)
            .parquet(self.folder.folder(output))
        )
        self.folder.publish(output, replaced, whole=True)

    def read(
        self,
        entity_key: str | None = None,
        *,
        since: dt.datetime | None = None,
        until: dt.datetime | None = None,
    ) -> DataFrame:
        """Rows of one key (default: of all), from ``since`` (inclusive) to ``until`` (exclusive)."""
        stored = [
            *self.view.schema(self.time_type).fields,
            T.StructField(EVENT_DATE, T.DateType()),
            T.StructField(CELLS, T.IntegerType()),
            T.StructField(KEY_CELL, T.IntegerType()),
            T.StructField(MONTH, T.DateType()),
        ]
        found = self.folder.read(T.StructType(stored))
        if found is None:
            full = T.StructType([*stored, T.StructField(BATCH, T.StringType())])
            found = self.spark.createDataFrame([], full)
        if entity_key is not None:
            key = F.lit(entity_key)
            found = found.where((F.col(KEY_CELL) == _cell(key, F.col(CELLS))) & (F.col(ENTITY_KEY) == key))
        for bound, lower in ((since, True), (until, False)):
            if bound is None:
                continue
            at = moment(micros_of(bound), self.time_type)
            day = at.cast("date")
            month = F.trunc(day, "month")
            inside = (
                (F.col(MONTH) >= month) & (F.col(EVENT_DATE) >= day) & (F.col(EVENT_TIME) >= at)
                if lower
                else (F.col(MONTH) <= month) & (F.col(EVENT_DATE) <= day) & (F.col(EVENT_TIME) < at)
            )
            found = found.where(inside)
        return found.drop(BATCH, CELLS, KEY_CELL, MONTH)

    def timeline(self, entity_key: str) -> DataFrame:
        """All rows of one entity in time order, as ``HistoryTable.timeline`` gives them."""
        return timeline(self.read(entity_key), entity_key, self.view.tie)
