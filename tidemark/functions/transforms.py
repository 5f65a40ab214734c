"""Feature transformations: one definition for batch and stream.

A transformation is a set of column expressions. The same expressions run in a batch job
and inside a streaming query, so the two paths cannot differ. ``PandasTransformation`` is
for logic that columns cannot express; it runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import default_if_null, round_even


@dataclass(frozen=True)
class Transformation:
    """Named output columns, each built from input columns.

    An input that the data lacks counts as null. Outputs are added; all other columns stay.
    """

    name: str
    inputs: tuple[str, ...]
    outputs: dict[str, Callable[[dict[str, Column]], Column]]
    description: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        given = {
            c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double")
            for c in self.inputs
        }
        return df.withColumns({name: build(given) for name, build in self.outputs.items()})


@dataclass(frozen=True)
class PandasTransformation:
    """Arbitrary Python over pandas batches, with declared output fields."""

    name: str
    inputs: tuple[str, ...]
    outputs: T.StructType
    func: Callable[[pd.DataFrame], pd.DataFrame]
    description: str = ""

    def apply(self, df: DataFrame) -> DataFrame:
        """Only the inputs go through pandas; all other columns stay as they are."""
        func, made = self.func, self.outputs.names

        @F.pandas_udf(self.outputs)
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            return func(batch)[made].reset_index(drop=True)

        given = F.struct(*[F.col(f"`{c}`") for c in self.inputs])
        kept = [F.col(f"`{c}`") for c in df.columns if c not in made]
        whole = df.select(*kept, run(given).alias("_made"))
        return whole.select(*kept, *[F.col("_made")[c].alias(c) for c in made])


@dataclass
class TransformationRegistry:
    known: dict[str, Transformation | PandasTransformation] = field(default_factory=dict)

    def register(self, transformation: Transformation | PandasTransformation) -> None:
        self.known[transformation.name] = transformation

    def get(self, name: str) -> Transformation | PandasTransformation:
        try:
            return self.known[name]
        except KeyError:
            raise ValueError(f"unknown transformation {name!r}") from None



# The defaults and factors below define the feature values.
FRAUD_RATIOS = Transformation(
    "fraud_ratios",
    ("tx_count_10m", "tx_count_1h", "risk_score", "device_trust_score"),
    {
        "velocity_ratio": lambda c: round_even(
            default_if_null(c["tx_count_10m"], 0)
            / F.greatest(default_if_null(c["tx_count_1h"], 1), F.lit(1.0)),
            4,
        ),
        "composite_risk": lambda c: round_even(
            default_if_null(c["risk_score"], 0.1)
            * (F.lit(1.0) - default_if_null(c["device_trust_score"], 0.9) * F.lit(0.5)),
            4,
        ),
    },
    "Share of the hour's transactions in the last minutes; risk lowered by device trust",
)

MERCHANT_EXPOSURE = Transformation(
    "merchant_exposure",
    ("chargeback_rate", "volume_30d"),
    {
        "exposure_score": lambda c: round_even(
            default_if_null(c["chargeback_rate"], 0.01)
            * F.sqrt(default_if_null(c["volume_30d"], 10000))
            / F.lit(100.0),
            4,
        ),
    },
    "Chargeback rate weighted by the root of the volume",
)

RATIO_CALC = Transformation(
    "ratio_calc",
    ("val_a", "val_b"),
    {
        "ratio": lambda c: round_even(
            default_if_null(c["val_a"], 1)
            / F.greatest(default_if_null(c["val_b"], 1), F.lit(0.001)),
            4,
        ),
    },
    "Ratio with a floor under the divisor",
)
