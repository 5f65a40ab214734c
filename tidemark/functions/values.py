"""Values of any feature type in one column: a struct for tables that mix features, VARIANT for fields nobody declared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.specs import DataType

TYPED = "struct<num: double, text: string, flag: boolean>"


def typed(value: str, dtype: DataType) -> Column:
    """The column ``value`` in the field of ``TYPED`` for its declared type, others null."""
    quoted = f"`{value}`" if "`" not in value else value
    num = f"CAST({quoted} AS DOUBLE)" if dtype.numeric else "CAST(NULL AS DOUBLE)"
    flag = quoted if dtype is DataType.BOOLEAN else "CAST(NULL AS BOOLEAN)"
    text = "CAST(NULL AS STRING)"
    if dtype in (DataType.STRING, DataType.JSON):
        text = f"CAST({quoted} AS STRING)"
    elif dtype is DataType.VECTOR:
        text = f"to_json({quoted})"
    return F.expr(f"named_struct('num', {num}, 'text', {text}, 'flag', {flag})")


def field_of(variant: Column, name: str, dtype: str) -> Column:
    """A top-level field of a VARIANT column as ``dtype``, null where it is absent or does not fit."""
    if "'" in name:
        raise ValueError(f"field name {name!r} holds a quote")
    return F.try_variant_get(variant, f"$['{name}']", dtype)


def field_type(variant: Column, name: str) -> Column:
    """The type that a top-level field of a VARIANT column has in this row, null where it is absent."""
    return F.schema_of_variant(field_of(variant, name, "variant"))


def json_field(text: Column, name: str, dtype: str) -> Column:
    """A top-level field of a JSON feature as ``dtype``, null where it is absent, the text is no JSON or
    the value does not fit."""
    return field_of(F.try_parse_json(text), name, dtype)
