"""Append-only feature history as Parquet, one folder a batch.

A batch has as many files as its bytes need, however many days it spans. Rows lie by event date, key and
time, so readers of some days skip pages and row groups by their statistics. ``compact`` puts one batch in
place of many small ones; what lands meanwhile stays, and a replay of a compacted batch is passed over.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import at_micros, epoch_micros, micros_of, moment, nan_to_null
from tidemark.operators.slicing import HOT, POINT, SkewPolicy, find_splits
from tidemark.sources.batches import BatchFolder, next_batch, read_or_none
from tidemark.specs import BATCH, CREATED_TIME, ENTITY_KEY, EVENT_DATE, EVENT_TIME, FeatureView


def normalise(
    df: DataFrame, view: FeatureView, *, now: dt.datetime | int | None = None
) -> DataFrame:
    """Rows as the history holds them.

    Keys become text, declared features get their declared type (null where a value does
    not fit), NaN becomes null, and a missing created time is filled in: ``now``, as a moment or in
    microseconds, or the time of the job. Columns that the
    view does not declare are kept: the table grows with its data. If the view has an ``extra`` column
    they go into it, with their own types; a batch may bring that column itself, as VARIANT, but then no
    other undeclared ones.
    """
    time_type = df.schema[EVENT_TIME].dataType
    if not isinstance(time_type, (T.TimestampType, T.TimestampNTZType)):
        time_type = T.TimestampType()
    created = F.current_timestamp()
    if now is not None:
        created = moment(now if isinstance(now, int) else micros_of(now), time_type)
    if CREATED_TIME in df.columns:
        created = F.col(CREATED_TIME)
    features: dict[str, Column] = {}
    declared_names = {*view.feature_names(), view.tie, view.extra}
    system = (ENTITY_KEY, EVENT_TIME, CREATED_TIME, EVENT_DATE, BATCH)
    others = [f for f in df.columns if view.extra and f not in declared_names and f not in system]
    if view.extra in df.columns and (others or not isinstance(df.schema[view.extra].dataType, T.VariantType)):
        raise ValueError(f"column {view.extra!r} holds undeclared fields and must be VARIANT and the only one: {others}")
    if others:
        features[view.extra] = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in others]))
    for field in df.schema.fields:
        if field.name in others or field.name in system:
            continue
        value = F.col(f"`{field.name}`")
        declared = view.get_feature(field.name)
        if declared is not None and field.dataType != declared.dtype.spark:
            value = value.try_cast(declared.dtype.spark)
        kept = declared.dtype.spark if declared is not None else field.dataType
        if isinstance(kept, (T.DoubleType, T.FloatType)):
            value = nan_to_null(value)
        features[field.name] = value
    return df.select(
        F.col(ENTITY_KEY).cast("string").alias(ENTITY_KEY),
        F.col(EVENT_TIME).cast(time_type).alias(EVENT_TIME),
        created.cast(time_type).alias(CREATED_TIME),
        *[c.alias(n) for n, c in features.items()],
    )


@dataclass(frozen=True)
class HistoryTable:
    """History of one view.

    A batch is one folder that is written as a whole, so writing it again after a failure
    replaces it instead of doubling its rows.
    """

    spark: SparkSession
    path: str
    view: FeatureView
    time_type: T.DataType = T.TimestampType()

    @property
    def folder(self) -> BatchFolder:
        return BatchFolder(self.spark, self.path)

    def append(
        self,
        df: DataFrame,
        batch: str | None = None,
        now: dt.datetime | int | None = None,
        measures: dict[str, Column] | None = None,
    ) -> dict[str, Any] | None:
        """Write a batch. ``measures``, aggregates over its rows by name, are taken in the same pass and
        returned; in them a declared feature that the batch lacks is null. A batch that is written again
        keeps the created time that it was given first, so a replay never looks newer than it is."""
        if now is None and batch is not None and CREATED_TIME not in df.columns:
            now = self._first_created(batch)
        rows = normalise(df, self.view, now=now).withColumn(EVENT_DATE, F.col(EVENT_TIME).cast("date"))
        return self._write(self._settled(rows), batch or next_batch(), measures)

    def _first_created(self, batch: str) -> int | None:
        """When a batch was first written, in microseconds; None for a new one."""
        held = read_or_none(self.spark, self.folder.folder(batch))
        if held is None or CREATED_TIME not in held.columns:
            return None
        at = F.min(epoch_micros(F.col(CREATED_TIME), held.schema[CREATED_TIME].dataType))
        found = held.agg(at.alias("at")).first().at
        if found is None:
            # Its space was freed after a compaction, which kept the time.
            kept = [r.first_created for r in self.folder.seen().records if r.replaced == batch]
            found = min((k for k in kept if k is not None), default=None)
        return found

    def _write(
        self, rows: DataFrame, batch: str, measures: dict[str, Column] | None = None
    ) -> dict[str, Any] | None:
        # The rebalance lets AQE size the files: few dates a file, and several files for a large date.
        rows = rows.hint("rebalance", EVENT_DATE).sortWithinPartitions(EVENT_DATE, ENTITY_KEY, EVENT_TIME)
        seen = None
        if measures:
            # After the last shuffle: a writing task that succeeds counts once, however often it ran.
            declared = self.view.schema(self.time_type).fields
            absent = {f.name: F.lit(None).cast(f.dataType) for f in declared if f.name not in rows.columns}
            seen = Observation(f"batch-{uuid.uuid4().hex}")
            rows = rows.withColumns(absent).observe(seen, *[m.alias(n) for n, m in measures.items()]).drop(*absent)
        rows.write.mode("overwrite").parquet(self.folder.folder(batch))
        return None if seen is None else seen.get

    def _settled(self, rows: DataFrame) -> DataFrame:
        """Columns that the view does not declare keep the type they first came with; a value that
        does not fit is null. Only tables with such columns pay for the look at the files."""
        declared = {*self.view.schema(self.time_type).names, EVENT_DATE}
        own = [f for f in rows.schema.fields if f.name not in declared]
        known = self.physical() if own else None
        types = {} if known is None else {f.name: f.dataType for f in known.schema.fields}
        changed = [f.name for f in own if types.get(f.name, f.dataType) != f.dataType]
        return rows.withColumns({c: F.col(f"`{c}`").try_cast(types[c]) for c in changed})

    def physical(self) -> DataFrame | None:
        """What the files hold, by their own schemas; None if nothing was ever written."""
        found = self.folder.read(mergeSchema="true")
        return None if found is None else found.drop(BATCH)

    def compact(self) -> None:
        """The same rows as one batch, in place of all batches there are now."""
        names = self.folder.seen().visible
        found = self.folder.read(names=names, mergeSchema="true") if names else None
        if found is None:
            return
        output = self.folder.output()
        self._write(found.drop(BATCH), output)
        counts = self._counts(names).withColumn("first_created", epoch_micros(F.col("first_created"), self.time_type))
        self.folder.publish(output, names, whole=False, counts=counts)

    def _counts(self, names: frozenset[str] | None = None) -> DataFrame:
        """Rows of batches, and when the first was created."""
        fields = T.StructType([T.StructField(CREATED_TIME, self.time_type)])
        found = self.folder.read(fields, names)
        if found is None:
            full = T.StructType([*fields.fields, T.StructField(BATCH, T.StringType())])
            found = self.spark.createDataFrame([], full)
        return found.groupBy(BATCH).agg(F.count("*").alias("row_count"), F.min(CREATED_TIME).alias("first_created"))

    def batches(self) -> DataFrame:
        """Rows of every batch that was ever appended, compacted since or not, and when its first was created."""
        seen = self.folder.seen()
        counted = self._counts(frozenset(seen.visible)).where(~F.col(BATCH).startswith("change-"))
        kept = [(r.replaced, r.row_count, r.first_created) for r in seen.records if r.replaced and not r.replaced.startswith("change-")]
        if not kept:
            return counted
        older = self.spark.createDataFrame(kept, f"{BATCH} string, row_count long, micros long")
        return counted.unionByName(older.select(BATCH, "row_count", at_micros(F.col("micros"), self.time_type).alias("first_created")))

    def read(self, *, evolved: bool = False) -> DataFrame:
        """All rows; columns that older files lack read as null.

        The declared schema needs no look at the files. ``evolved`` also finds columns that
        the view does not declare, at the price of reading every file footer.
        """
        declared = self.view.schema(self.time_type)
        if evolved:
            found = self.physical()
            if found is None or EVENT_TIME not in found.columns:
                return self.empty()
            missing = [f for f in declared.fields if f.name not in found.columns]
            return found.withColumns(
                {f.name: F.lit(None).cast(f.dataType) for f in missing}
            )
        found = self.folder.read(T.StructType([*declared.fields, T.StructField(EVENT_DATE, T.DateType())]))
        return self.empty() if found is None else found.drop(BATCH)

    def read_batch(self, batch: str) -> DataFrame:
        """The rows of one batch, with all their columns."""
        found = read_or_none(self.spark, self.folder.folder(batch))
        return self.empty() if found is None else found

    def bucketed(
        self,
        table: str,
        buckets: int,
        *,
        path: str | None = None,
        policy: SkewPolicy | None = None,
    ) -> DataFrame:
        """The history as catalog table ``table`` at ``path``, bucketed by key.

        Point-in-time joins with ``buckets`` do not shuffle such tables. One task writes the
        one file of a bucket. Only rows of very large keys are spread over tasks by time; a
        null is passed over by the partitioning hash, so all others go by their key alone.
        """
        rows = self.read()
        timed = rows.withColumn("_at", epoch_micros(F.col(EVENT_TIME), self.time_type))
        splits = find_splits(timed, [ENTITY_KEY], "_at", policy)
        if splits:
            rows = splits.assign(timed)
        by_time = [F.when(F.col(HOT), F.col(c)) for c in splits.slices]
        (
            rows.repartition(buckets, ENTITY_KEY, *by_time)
            .drop("_at", HOT, POINT, *splits.slices)
            .write.mode("overwrite")
            .option("path", path or f"{self.path}-by-key/{next_batch()}")
            .bucketBy(buckets, ENTITY_KEY)
            .saveAsTable(table)
        )
        return self.spark.table(table)

    def empty(self) -> DataFrame:
        fields = [*self.view.schema(self.time_type).fields, T.StructField(EVENT_DATE, T.DateType())]
        return self.spark.createDataFrame([], T.StructType(fields))

    def timeline(self, entity_key: str) -> DataFrame:
        return timeline(self.read(), entity_key, self.view.tie)

    def count(self) -> int:
        return self.read().count()


def timeline(history: DataFrame, entity_key: str, tie: str | None = None) -> DataFrame:
    """All rows of one entity in time order, then by created time and ``tie``."""
    order = [c for c in (EVENT_TIME, CREATED_TIME, tie) if c and c in history.columns]
    return history.where(F.col(ENTITY_KEY) == entity_key).orderBy(*order)


def count_by_view(histories: dict[str, DataFrame | None]) -> DataFrame:
    """Row count of every view, 0 for a view without data."""
    parts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("feature_view"), "row_count"
        )
        for name, df in histories.items()
        if df is not None
    ]
    spark = next(df for df in histories.values() if df is not None).sparkSession
    empty = [(n, 0) for n, df in histories.items() if df is None]
    if empty:
        parts.append(spark.createDataFrame(empty, "feature_view string, row_count long"))
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted
