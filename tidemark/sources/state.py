"""Latest state per entity as a Parquet table of deltas.

An upsert writes only the entities it touches, so its cost follows the batch and not the
state. Reading takes the newest value of every feature over all deltas, in one aggregation
with map-side combine. ``compact`` puts the merged state in place of the deltas when they have
grown; ``replace`` does the same with a new state. Deltas that land meanwhile stay.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import epoch_micros
from tidemark.sources.batches import BatchFolder, next_batch, read_or_none
from tidemark.specs import ENTITY_KEY, FeatureView

COMMIT = "commit"


def state_schema(view: FeatureView, time_type: T.DataType) -> T.StructType:
    tie = view.get_feature(view.tie) if view.tie else None
    order = [
        T.StructField("ts", time_type),
        T.StructField("created", time_type),
        T.StructField("tie", tie.dtype.spark if tie else T.LongType()),
    ]
    cells = [
        T.StructField(f.name, T.StructType([T.StructField("value", f.dtype.spark), *order]))
        for f in view.features
    ]
    return T.StructType([T.StructField(ENTITY_KEY, T.StringType()), *cells])


def merge_states(deltas: DataFrame, view: FeatureView, order: str = COMMIT) -> DataFrame:
    """Newest value of every feature, in the order of history: time, created time, tie column;
    if all are equal, the delta written last.

    Features merge one by one, so a delta may hold some of them only.
    """
    cells = [f for f in view.feature_names() if f in deltas.columns]
    return deltas.groupBy(ENTITY_KEY).agg(
        *[
            F.max_by(
                F.col(f"`{f}`"),
                F.when(
                    F.col(f"`{f}`").isNotNull(),
                    F.struct(*[F.col(f"`{f}`.{c}") for c in ("ts", "created", "tie")], F.col(order)),
                ),
            ).alias(f)
            for f in cells
        ]
    )


@dataclass(frozen=True)
class StateTable:
    """State of one view."""

    spark: SparkSession
    path: str
    view: FeatureView
    time_type: T.DataType = T.TimestampType()

    @property
    def folder(self) -> BatchFolder:
        return BatchFolder(self.spark, self.path)

    def upsert(self, state: DataFrame, batch: str | None = None) -> None:
        """Add a delta; writing the same batch again replaces it. Where a change has replaced the batch,
        it becomes a delta anew: merging the same values twice changes nothing."""
        name = batch or next_batch()
        if batch is not None and batch in self.folder.seen().hidden:
            name = f"{batch}-{next_batch()}"
        self._write(state, name)

    def deltas(self) -> frozenset[str]:
        """Names of the deltas there are now; take them before reading what ``replace`` is to write."""
        return self.folder.seen().visible

    def replace(self, state: DataFrame, deltas: frozenset[str] | None = None) -> None:
        """Put ``state`` in place of ``deltas``, by default of all there are when it is called."""
        self._change(state, self.deltas() if deltas is None else deltas, whole=True)

    def _change(self, state: DataFrame, deltas: frozenset[str], *, whole: bool) -> None:
        output = self.folder.output()
        self._write(state, output)
        self.folder.publish(output, deltas, whole=whole)

    def _write(self, state: DataFrame, batch: str) -> None:
        def cell(field: T.StructField) -> Column:
            if field.name not in state.columns:
                return F.lit(None).cast(field.dataType).alias(field.name)
            if field.name == ENTITY_KEY:
                return F.col(ENTITY_KEY).cast("string")
            held, column = state.schema[field.name].dataType, F.col(f"`{field.name}`")
            parts = [
                (column[p.name] if p.name in held.names else F.lit(None)).cast(p.dataType).alias(p.name)
                for p in field.dataType.fields
            ]
            return F.when(column.isNotNull(), F.struct(*parts)).alias(field.name)

        rows = state.select(*[cell(f) for f in state_schema(self.view, self.time_type).fields])
        rows = rows.withColumn(COMMIT, F.lit(time.time_ns()))
        rows.write.mode("overwrite").parquet(self.folder.folder(batch))

    def read(self) -> DataFrame:
        return self._merged(None)

    def _merged(self, deltas: frozenset[str] | None) -> DataFrame:
        schema = state_schema(self.view, self.time_type)
        found = self.folder.read(T.StructType([*schema.fields, T.StructField(COMMIT, T.LongType())]), deltas)
        return self.spark.createDataFrame([], schema) if found is None else merge_states(found, self.view)

    def read_batch(self, batch: str) -> DataFrame:
        """The delta of one batch."""
        return self.spark.read.schema(state_schema(self.view, self.time_type)).parquet(self.folder.folder(batch))

    def first_created(self, batch: str) -> int | None:
        """The created time that a delta carries, in microseconds; None if there is no such delta."""
        held = read_or_none(self.spark, self.folder.folder(batch))
        if held is None or not self.view.features:
            return None
        cells = [F.max(epoch_micros(F.col(f"`{f}`.created"), self.time_type)) for f in self.view.feature_names()]
        return max((at for at in held.agg(*cells).first() if at is not None), default=None)

    def compact(self) -> None:
        """The same state as one delta."""
        deltas = self.deltas()
        if deltas:
            self._change(self._merged(deltas), deltas, whole=False)
