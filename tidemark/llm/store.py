"""Results that several jobs read, and files that tasks read and write themselves."""

from __future__ import annotations

import ctypes
import math
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir, written

__all__ = ["buckets_for", "file_system", "lean", "new_name", "spread", "table", "work_dir", "written"]


_Batch = TypeVar("_Batch")


def lean(batches: Iterator[_Batch]) -> Iterator[_Batch]:
    """The same batches; after the last, the worker gives the memory it has freed back to the system.

    Spark keeps Python workers for the next task: what they hold without need is missing elsewhere."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(texts: DataFrame, column: str, chars_per_bucket: int) -> int:
    """So many hash buckets that each gets about ``chars_per_bucket`` characters, and at least two
    a shuffle partition. The bucket count follows the data, so a bucket's size does not."""
    chars = texts.agg(F.sum(F.length(column).cast("long"))).first()[0] or 0
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * partitions, math.ceil(chars / chars_per_bucket))


def spread(tasks: DataFrame, *columns: str) -> DataFrame:
    """Small rows that each stand for much work, over all shuffle partitions: a stated number, which
    AQE does not lower because the rows are few bytes."""
    return tasks.repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def file_system(uri: str):
    """Arrow's file system for a folder's address, and the folder's path on it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return fs.LocalFileSystem(), uri


def new_name(prefix: str, suffix: str) -> str:
    """A file name no other task attempt uses."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
