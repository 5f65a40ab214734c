"""Entities, features, feature views and feature references.

Plain driver-side metadata. A view's declared types are the truth: data is cast to them
on write and every reference is checked against them before a job starts.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any, NamedTuple

from pyspark.sql import types as T

ENTITY_KEY = "entity_key"
EVENT_TIME = "event_timestamp"
CREATED_TIME = "created_timestamp"
EVENT_DATE = "event_date"
BATCH = "batch"
SYSTEM_COLUMNS = (ENTITY_KEY, EVENT_TIME, CREATED_TIME)

DEFAULT_VIEW = "default"


class DataType(str, Enum):
    INT64 = "INT64"
    FLOAT64 = "FLOAT64"
    STRING = "STRING"
    BOOLEAN = "BOOLEAN"
    VECTOR = "VECTOR"
    JSON = "JSON"

    @property
    def spark(self) -> T.DataType:
        return _SPARK_TYPES[self]

    @property
    def numeric(self) -> bool:
        return self in (DataType.INT64, DataType.FLOAT64)

    @classmethod
    def parse(cls, name: str) -> DataType:
        """Type from a case-insensitive name; an unknown name means FLOAT64."""
        wanted = name.upper()
        if wanted == "BOOL":
            return cls.BOOLEAN
        return cls.__members__.get(wanted, cls.FLOAT64)


_SPARK_TYPES = {
    DataType.INT64: T.LongType(),
    DataType.FLOAT64: T.DoubleType(),
    DataType.STRING: T.StringType(),
    DataType.BOOLEAN: T.BooleanType(),
    DataType.VECTOR: T.ArrayType(T.FloatType()),
    DataType.JSON: T.StringType(),
}


@dataclass(frozen=True)
class Entity:
    name: str
    join_keys: tuple[str, ...]
    description: str = ""


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: DataType = DataType.FLOAT64
    description: str = ""
    default_value: Any = None
    min_value: float | str | None = None
    max_value: float | str | None = None


@dataclass(frozen=True)
class FeatureView:
    """A named feature table.

    ``tie`` names a column that decides between rows of one entity with equal event and
    created time (largest wins). ``extra`` names one VARIANT column that takes all columns that the view
    does not declare, each value with its own type, so that a type may change between batches.
    """

    name: str
    entity_name: str
    features: tuple[Feature, ...]
    ttl_seconds: int | None = None
    transformation_name: str | None = None
    online: bool = True
    offline: bool = True
    description: str = ""
    tie: str | None = None
    extra: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "features", tuple(self.features))
        if self.ttl_seconds is not None and self.ttl_seconds <= 0:
            raise ValueError(f"view {self.name!r}: ttl_seconds must be positive or None")
        names = self.feature_names()
        clash = {n for n in names if n in SYSTEM_COLUMNS or names.count(n) > 1}
        if clash:
            raise ValueError(f"view {self.name!r}: reserved or repeated names {sorted(clash)}")
        if self.extra in (*names, *SYSTEM_COLUMNS, EVENT_DATE, BATCH) or self.extra and self.extra == self.tie:
            raise ValueError(f"view {self.name!r}: the name {self.extra!r} is taken")

    def feature_names(self) -> list[str]:
        return [f.name for f in self.features]

    def get_feature(self, name: str) -> Feature | None:
        return next((f for f in self.features if f.name == name), None)

    def schema(self, time_type: T.DataType | None = None) -> T.StructType:
        """Declared schema of the history table."""
        at = time_type or T.TimestampType()
        system = [
            T.StructField(ENTITY_KEY, T.StringType()),
            T.StructField(EVENT_TIME, at),
            T.StructField(CREATED_TIME, at),
        ]
        if self.tie and self.tie not in self.feature_names():
            system.append(T.StructField(self.tie, T.LongType()))
        extra = [T.StructField(self.extra, T.VariantType())] if self.extra else []
        return T.StructType(
            system
            + extra
            + [
                T.StructField(
                    f.name,
                    f.dtype.spark,
                    metadata={
                        k: v
                        for k, v in (("min", f.min_value), ("max", f.max_value))
                        if v is not None
                    },
                )
                for f in self.features
            ]
        )


class Ref(NamedTuple):
    """A feature reference ``view:feature``."""

    view: str
    feature: str

    @property
    def label(self) -> str:
        return f"{self.view}:{self.feature}"

    @classmethod
    def parse(cls, text: str) -> Ref:
        view, colon, feature = text.partition(":")
        return cls(view, feature) if colon else cls(DEFAULT_VIEW, text)


def refs_by_view(refs: list[str]) -> dict[str, list[str]]:
    """Requested features per view, both in first-seen order and without repeats."""
    wanted: dict[str, list[str]] = {}
    for ref in map(Ref.parse, refs):
        names = wanted.setdefault(ref.view, [])
        if ref.feature not in names:
            names.append(ref.feature)
    return wanted


@dataclass
class Registry:
    """Entities and views by name; registering a name again replaces it."""

    entities: dict[str, Entity] = field(default_factory=dict)
    views: dict[str, FeatureView] = field(default_factory=dict)

    def register_entity(self, entity: Entity) -> Entity:
        self.entities[entity.name] = entity
        return entity

    def register_feature_view(self, view: FeatureView) -> FeatureView:
        if view.entity_name not in self.entities:
            raise ValueError(f"view {view.name!r} names unknown entity {view.entity_name!r}")
        self.views[view.name] = view
        return view

    def to_dict(self) -> dict[str, list[dict[str, Any]]]:
        """All definitions as plain values that JSON can hold."""
        return {
            "entities": [asdict(e) for e in self.entities.values()],
            "feature_views": [asdict(v) for v in self.views.values()],
        }

    @classmethod
    def from_dict(cls, made: dict[str, list[dict[str, Any]]]) -> Registry:
        registry = cls()
        for e in made["entities"]:
            registry.register_entity(Entity(**{**e, "join_keys": tuple(e["join_keys"])}))
        for v in made["feature_views"]:
            features = tuple(Feature(**{**f, "dtype": DataType(f["dtype"])}) for f in v["features"])
            registry.register_feature_view(FeatureView(**{**v, "features": features}))
        return registry

    def view(self, name: str) -> FeatureView:
        try:
            return self.views[name]
        except KeyError:
            raise ValueError(f"unknown feature view {name!r}") from None

    def feature(self, ref: str) -> Feature:
        parsed = Ref.parse(ref)
        found = self.view(parsed.view).get_feature(parsed.feature)
        if found is None:
            raise ValueError(f"view {parsed.view!r} declares no feature {parsed.feature!r}")
        return found

    def check_refs(self, refs: list[str]) -> None:
        for ref in refs:
            self.feature(ref)

    def numeric_refs(self) -> list[str]:
        return [
            f"{v.name}:{f.name}" for v in self.views.values() for f in v.features if f.dtype.numeric
        ]
