"""A table as a folder of batches, and changes that put one batch in place of others.

A batch is one folder that is written as a whole; writing it again replaces it. A change (a
compaction, a backfill, retention) writes its output as a batch that nobody sees yet, and then
publishes in one file which batches it stands for. Readers see every batch that no change names.
So a batch that lands while a change runs is in no change and stays, and a replay of a batch that was
compacted writes to a folder that stays out of sight.

Changes that run side by side: a replacement counts always; a rewrite (the same rows anew) counts if
none of its batches is named by a replacement or by an earlier rewrite. One that doesn't count is as if it
had not run. Names of batches are metadata of the driver, as the list of files is.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.specs import BATCH

_CHANGE = "change-"
_RECORD = "change string, output string, whole boolean, replaced string, row_count long, first_created long"


def next_batch() -> str:
    """A name for a batch that sorts after all earlier ones."""
    return f"{time.time_ns():020d}"


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_or_none(spark: SparkSession, path: str, **options: object) -> DataFrame | None:
    """A Parquet table, or None if nothing was ever written to ``path``."""
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as error:
        if path_missing(error):
            return None
        raise


@dataclass(frozen=True)
class Seen:
    """Batches that readers see, those they don't, and the records of changes that count."""

    visible: frozenset[str]
    hidden: frozenset[str]
    records: tuple


@dataclass(frozen=True)
class BatchFolder:
    spark: SparkSession
    path: str

    def folder(self, batch: str) -> str:
        return f"{self.path}/{BATCH}={batch}"

    def present(self) -> set[str]:
        """Names of all batches; a listing, not a job."""
        try:
            files = self.spark.read.schema("_none int").parquet(self.path).inputFiles()
        except AnalysisException as error:
            if path_missing(error):
                return set()
            raise
        return {found.group(1) for f in files if (found := re.search(rf"/{BATCH}=([^/]+)/", f))}

    def seen(self) -> Seen:
        """One small read where changes were ever published, else a listing alone."""
        present = self.present()
        try:
            records = self.spark.read.schema(_RECORD).json(f"{self.path}-changes").collect()
        except AnalysisException as error:
            if not path_missing(error):
                raise
            records = []
        named: dict[str, set[str]] = {}
        outputs, whole = {}, {}
        for r in records:
            named.setdefault(r.change, set())
            if r.replaced is not None:
                named[r.change].add(r.replaced)
            outputs[r.change], whole[r.change] = r.output, r.whole
        hidden = {b for c, names in named.items() if whole[c] for b in names}
        counts = {c for c in named if whole[c]}
        known = {outputs[c] for c in counts}
        for change in sorted(c for c in named if not whole[c]):
            names = named[change]
            made = {n for n in names if n.startswith(_CHANGE)}
            if names & hidden or not made <= known:
                continue
            counts.add(change)
            known.add(outputs[change])
            hidden |= names
        hidden |= {b for b in present if b.startswith(_CHANGE) and b not in known}
        return Seen(
            frozenset(present - hidden),
            frozenset(present & hidden),
            tuple(r for r in records if r.change in counts),
        )

    def read(self, schema: T.StructType | None = None, names: frozenset[str] | None = None, **options: object) -> DataFrame | None:
        """Rows of the visible batches, or of those named, with their ``batch``; None if there are no files."""
        reader = self.spark.read.options(**options)
        if schema is not None:
            # Names are text, also where all are digits.
            reader = reader.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())]))
        try:
            found = reader.parquet(self.path)
        except AnalysisException as error:
            if path_missing(error):
                return None
            raise
        if schema is None:
            return self.read(T.StructType([f for f in found.schema.fields if f.name != BATCH]), names)
        if names is not None:
            return found.where(F.col(BATCH).isin(*sorted(names)))
        hidden = self.seen().hidden
        return found.where(~F.col(BATCH).isin(*sorted(hidden))) if hidden else found

    def output(self) -> str:
        """A name for the output of a change."""
        return f"{_CHANGE}{next_batch()}-{uuid.uuid4().hex[:8]}"

    def publish(
        self, output: str | None, replaced: frozenset[str], *, whole: bool, counts: DataFrame | None = None
    ) -> None:
        """Put ``output`` in place of the batches ``replaced``; ``whole`` says that it is a replacement.

        ``counts`` (batch, row_count, first_created in microseconds) is kept with the names."""
        change = output or self.output()
        rows = [(change, output, whole, b) for b in sorted(replaced)] or [(change, output, whole, None)]
        named = self.spark.createDataFrame(rows, "change string, output string, whole boolean, replaced string")
        if counts is None:
            record = named.withColumns({"row_count": F.lit(None).cast("long"), "first_created": F.lit(None).cast("long")})
        else:
            of = counts.select(F.col(BATCH).alias("replaced"), "row_count", "first_created")
            record = named.join(of, "replaced", "left")
        # One file: it is there or it is not.
        record.drop("change").coalesce(1).write.mode("overwrite").json(f"{self.path}-changes/change={change}")

    def release(self) -> None:
        """Free the space of batches out of sight. Jobs that began before and still read them fail."""
        for batch in sorted(self.seen().hidden):
            held = read_or_none(self.spark, self.folder(batch))
            if held is not None and held.columns:
                nothing = self.spark.createDataFrame([], held.schema)
                nothing.coalesce(1).write.mode("overwrite").parquet(self.folder(batch))
