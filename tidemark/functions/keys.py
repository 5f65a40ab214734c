"""Entity keys from join keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.specs import ENTITY_KEY, Entity


def entity_key(join_keys: Sequence[str]) -> Column:
    """One join key as text; of several, each with its length before it, so that no two lists of keys
    give the same text. Null if any is null."""
    parts = [F.col(f"`{k}`").cast("string") for k in join_keys]
    if len(parts) == 1:
        return parts[0]
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def with_entity_key(df: DataFrame, entity: Entity) -> DataFrame:
    """``df`` with the entity's key, made of its join keys where the column is not there already."""
    if ENTITY_KEY in df.columns:
        return df
    missing = [k for k in entity.join_keys if k not in df.columns]
    if missing:
        raise ValueError(f"no column {ENTITY_KEY!r} and no join keys {missing} of entity {entity.name!r}")
    return df.withColumn(ENTITY_KEY, entity_key(entity.join_keys))
