"""Results as CSV files and as JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import iso_time, nan_to_null


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per partition; times in ISO-8601, null as empty, arrays, maps
    and structs as JSON."""
    nested = {f.name: F.to_json(F.col(f"`{f.name}`")) for f in df.schema.fields if _nested(f)}
    _text_times(df).withColumns(nested).write.mode("overwrite").option("header", True).csv(path)


def read_csv(df: DataFrame, path: str) -> DataFrame:
    """Read files written by ``write_csv`` of ``df`` back to its types."""
    flat = [T.StructField(f.name, T.StringType()) if _nested(f) else f for f in df.schema.fields]
    found = (
        df.sparkSession.read.schema(T.StructType(flat))
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )
    nested = {f.name: F.from_json(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields if _nested(f)}
    return found.withColumns(nested)


def _nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))


def json_safe(df: DataFrame) -> DataFrame:
    """Times as ISO-8601 text, NaN as null."""
    doubles = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return _text_times(df).withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in doubles})


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row, null fields included."""
    safe = json_safe(df)
    whole = F.struct(*[F.col(f"`{c}`") for c in safe.columns])
    return safe.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias(name))


def _text_times(df: DataFrame) -> DataFrame:
    times = [
        f
        for f in df.schema.fields
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
    ]
    return df.withColumns({f.name: iso_time(F.col(f"`{f.name}`"), f.dataType) for f in times})
