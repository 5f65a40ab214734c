"""Append-only logs: served features, job audit, and newest-first views of them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import typed
from tidemark.sources.batches import BatchFolder, next_batch
from tidemark.specs import BATCH, ENTITY_KEY, EVENT_TIME, DataType


def newest(log: DataFrame, limit: int, at: str, *tie: str) -> DataFrame:
    """The newest ``limit`` rows, newest first; ties go to the largest tie columns."""
    return log.orderBy(F.desc(at), *[F.desc(c) for c in tie]).limit(limit)


def served_features(
    served: DataFrame,
    refs: dict[str, DataType],
    *,
    inference_id: Column,
    at: Column,
    asked: dict[str, Column] | None = None,
) -> DataFrame:
    """Inference log rows for served feature rows.

    The features of one inference are a map from reference to typed value. A reference that
    was not asked for (``asked`` false) has no entry, which differs from a null value.
    """
    entries = [
        F.struct(
            F.lit(ref).alias("ref"),
            typed(ref, dtype).alias("value"),
            (asked or {}).get(ref, F.lit(True)).alias("asked"),
        )
        for ref, dtype in refs.items()
    ]
    kept = F.filter(F.array(*entries), lambda e: e["asked"])
    pairs = F.transform(kept, lambda e: F.struct(e["ref"], e["value"]))
    return served.select(
        inference_id.alias("inference_id"),
        ENTITY_KEY,
        at.alias(EVENT_TIME),
        F.map_from_entries(pairs).alias("features"),
    )


@dataclass(frozen=True)
class LogTable:
    """A log as a Parquet table with one folder per appended batch."""

    spark: SparkSession
    path: str

    @property
    def folder(self) -> BatchFolder:
        return BatchFolder(self.spark, self.path)

    def append(self, rows: DataFrame, batch: str | None = None) -> None:
        rows.write.mode("overwrite").parquet(self.folder.folder(batch or next_batch()))

    def read(self) -> DataFrame | None:
        found = self.folder.read()
        return None if found is None else found.drop(BATCH)

    def compact(self, since: Column | None = None) -> None:
        """The log as one batch; rows for which ``since`` does not hold are let go. ``expire`` alone lets
        rows go without writing all others anew."""
        self._rewrite(self.folder.seen().visible, since, whole=since is not None)

    def _rewrite(self, names: frozenset[str], kept: Column | None, *, whole: bool) -> None:
        held = self.folder.read(names=names) if names else None
        if held is None:
            return
        output = self.folder.output()
        (held if kept is None else held.where(kept)).drop(BATCH).write.parquet(self.folder.folder(output))
        self.folder.publish(output, names, whole=whole)

    def expire(self, kept: Column) -> None:
        """Let go of the rows for which ``kept`` does not hold (retention).

        Batches without a row to keep go out of sight as they are; only those that hold rows of both
        kinds are written anew. All others are not touched."""
        names = self.folder.seen().visible
        held = self.folder.read(names=names) if names else None
        if held is None:
            return
        counts = held.groupBy(BATCH).agg(F.count_if(kept).alias("stay"), F.count("*").alias("n"))
        # One row a batch.
        found = counts.where("stay < n").collect()
        over = frozenset(r[BATCH] for r in found if not r["stay"])
        if over:
            self.folder.publish(None, over, whole=True)
        self._rewrite(frozenset(r[BATCH] for r in found if r["stay"]), kept, whole=True)


@dataclass(frozen=True)
class AuditLog:
    """Trail of what the jobs did: time, action, details."""

    table: LogTable

    def record(self, action: str, details: str) -> None:
        now = dt.datetime.now(dt.timezone.utc)
        row = [(now, action, details)]
        schema = "timestamp timestamp, action string, details string"
        self.table.append(self.table.spark.createDataFrame(row, schema).coalesce(1))

    def read(self) -> DataFrame | None:
        return self.table.read()

    def recent(self, limit: int) -> DataFrame | None:
        held = self.read()
        return None if held is None else newest(held, limit, "timestamp", "action")
