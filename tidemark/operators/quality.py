"""Data quality: declared rules, checked with one aggregation per table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import round_even
from tidemark.operators.pit import ViewData
from tidemark.specs import ENTITY_KEY, EVENT_TIME, DataType, Feature, FeatureView

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("expected", T.StringType()),
        T.StructField("observed", T.StringType()),
    ]
)


# Categories and texts of the rule table.
SCHEMA, COMPLETENESS, VALIDITY = "SCHEMA", "COMPLETENESS", "VALIDITY"
PARITY, PERFORMANCE = "PARITY", "PERFORMANCE"
NO_NULLS = "0 nulls (100% complete)"
IN_BOUNDS = "0 out-of-bounds rows"
NO_NEGATIVES = "0 negative count rows"
NO_SKEW = "0.0000% skew (100.000% parity)"
SCHEMA_NAME = "Schema Columns Integrity ({})"
PARITY_NAME = "Training-Serving Parity (Zero Skew Guarantee)"
LATENCY_NAME = "Online Serving Latency SLA Bound (p50 < {:.2f} ms)"
PASSED, WARNING = "PASSED", "WARNING"


@dataclass(frozen=True)
class Rule:
    """A check on one table.

    ``measure`` is an aggregate over all rows of the table; ``passed`` and ``observed`` are
    made from its result and from the row count.
    """

    rule_id: str
    name: str
    category: str
    expected: str
    columns: tuple[str, ...]
    measure: Callable[[], Column]
    passed: Callable[[Column], Column]
    observed: Callable[[Column, Column], Column]


def _none(found: Column) -> Column:
    return found == 0


def _violating(found: Column, rows: Column) -> Column:
    return F.concat(found.cast("string"), F.lit(" violating rows"))


def not_null(rule_id: str, name: str, column: str) -> Rule:
    def observed(found: Column, rows: Column) -> Column:
        share = F.when(rows == 0, F.lit(0.0)).otherwise(round_even(found / rows * 100.0, 2))
        return F.concat(
            found.cast("string"),
            F.lit(" nulls out of "),
            rows.cast("string"),
            F.lit(" rows ("),
            share.cast("string"),
            F.lit("%)"),
        )

    return Rule(
        rule_id,
        name,
        COMPLETENESS,
        NO_NULLS,
        (column,),
        lambda: F.count_if(F.col(f"`{column}`").isNull()),
        _none,
        observed,
    )


def in_range(rule_id: str, name: str, column: str, low: float, high: float) -> Rule:
    def outside() -> Column:
        value = F.col(f"`{column}`")
        return F.count_if((value < low) | (value > high))

    return Rule(
        rule_id,
        name,
        VALIDITY,
        IN_BOUNDS,
        (column,),
        outside,
        _none,
        _violating,
    )


def not_negative(rule_id: str, name: str, *columns: str) -> Rule:
    return Rule(
        rule_id,
        name,
        VALIDITY,
        NO_NEGATIVES,
        columns,
        lambda: F.count_if(reduce(Column.__or__, [F.col(f"`{c}`") < 0 for c in columns])),
        _none,
        _violating,
    )


def measures(rules: list[Rule], columns: Sequence[str]) -> dict[str, Column]:
    """What one pass over a table has to find for the rules that its columns allow, and its rows."""
    runnable = {f"_m{i}": r.measure() for i, r in enumerate(rules) if set(r.columns) <= set(columns)}
    return {"_rows": F.count(F.lit(1)), **runnable}


def judged(measured: DataFrame, rules: list[Rule], columns: Sequence[str], *keys: str) -> DataFrame:
    """The rule rows of a measured table; ``keys`` are kept in front of them."""
    results = []
    for i, rule in enumerate(rules):
        missing = sorted(set(rule.columns) - set(columns))
        passed, observed = F.lit(False), F.lit(f"Missing columns: {missing}")
        if not missing:
            found = F.col(f"_m{i}")
            passed, observed = rule.passed(found), rule.observed(found, F.col("_rows"))
        results.append(
            F.struct(
                F.lit(rule.rule_id).alias("rule_id"),
                F.lit(rule.name).alias("name"),
                F.lit(rule.category).alias("category"),
                passed.alias("passed"),
                F.lit(rule.expected).alias("expected"),
                observed.alias("observed"),
            )
        )
    return measured.select(*keys, F.inline(F.array(*results)))


def check_table(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rules of a table in one scan. A rule whose columns are missing has not passed."""
    found = df.agg(*[m.alias(n) for n, m in measures(rules, df.columns).items()])
    return judged(found, rules, df.columns)


def schema_rules(held: list[ViewData], spark: SparkSession | None = None) -> DataFrame:
    """For every view whether its table has the key, the time and all declared columns.

    ``data`` is the table as it is stored, not as read with the declared schema, and None if it was
    never written. ``spark`` is needed if none was.
    """
    rows = []
    for view_data in held:
        view = view_data.view
        expected = {ENTITY_KEY, EVENT_TIME, *view.feature_names()}
        present = set() if view_data.data is None else set(view_data.data.columns)
        missing = sorted(expected - present)
        rows.append(
            (
                f"schema_columns_{view.name}",
                SCHEMA_NAME.format(view.name),
                SCHEMA,
                not missing,
                f"All {len(expected)} columns present",
                f"Missing: {missing}" if missing else f"All {len(present)} columns present",
            )
        )
    spark = spark or next(v.data for v in held if v.data is not None).sparkSession
    return spark.createDataFrame(rows, RULE_SCHEMA)


def parity_rule(parity_summary: DataFrame) -> DataFrame:
    """Served values equal history."""
    return parity_summary.select(
        F.lit("zero_skew_guarantee").alias("rule_id"),
        F.lit(PARITY_NAME).alias("name"),
        F.lit(PARITY).alias("category"),
        (F.col("skew_rate_percent") == 0.0).alias("passed"),
        F.lit(NO_SKEW).alias("expected"),
        F.format_string(
            "%.4f%% skew across %d checked values", "skew_rate_percent", "total_checks"
        ).alias("observed"),
    )


def latency_rule(percentiles: DataFrame, bound: float = 0.5) -> DataFrame:
    """The median of a measured latency is below a bound."""
    return percentiles.select(
        F.lit("serving_latency_sla").alias("rule_id"),
        F.lit(LATENCY_NAME.format(bound)).alias("name"),
        F.lit(PERFORMANCE).alias("category"),
        (F.col("p50") < bound).alias("passed"),
        F.lit(f"p50 latency < {bound:.2f} ms").alias("expected"),
        F.format_string(
            "p50 = %.3f ms, p99 = %.3f ms", round_even(F.col("p50"), 3), round_even(F.col("p99"), 3)
        ).alias("observed"),
    )


def quality_score(rules: DataFrame) -> DataFrame:
    """Counts, score in percent, and ``PASSED`` only if every rule passed."""
    total, good = F.col("total_rules"), F.col("passed_count")
    counted = rules.agg(
        F.count("*").alias("total_rules"), F.count_if("passed").alias("passed_count")
    )
    share = good / F.greatest(total, F.lit(1)) * 100.0
    return counted.select(
        "total_rules",
        "passed_count",
        (total - good).alias("failed_count"),
        round_even(share, 1).alias("quality_score_percent"),
        F.when(good == total, F.lit(PASSED)).otherwise(F.lit(WARNING)).alias("status"),
    )


def valid(feature: Feature, df: DataFrame) -> Column:
    """Whether a value has the feature's type and lies within its inclusive bounds.

    Null is valid. An integer is a valid FLOAT64, as is a boolean a valid INT64 or FLOAT64. Booleans
    count as 0 and 1; texts have texts as bounds, in code-point order; other types have no order.
    """
    dtype = df.schema[feature.name].dataType
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
    accepted = {
        DataType.INT64: whole,
        DataType.FLOAT64: (*whole, T.FloatType, T.DoubleType),
        DataType.STRING: (T.StringType,),
        DataType.BOOLEAN: (T.BooleanType,),
    }.get(feature.dtype)
    if accepted is not None and not isinstance(dtype, accepted):
        return F.col(f"`{feature.name}`").isNull()
    return _within(feature)


def _within(feature: Feature) -> Column:
    """Whether a value of an accepted type lies within the feature's bounds."""
    value = F.col(f"`{feature.name}`")
    bounds = [b for b in (feature.min_value, feature.max_value) if b is not None]
    text = feature.dtype is DataType.STRING
    ordered = text or feature.dtype.numeric or feature.dtype is DataType.BOOLEAN
    if bounds and (not ordered or any(isinstance(b, str) is not text for b in bounds)):
        raise ValueError(f"feature {feature.name!r}: {feature.dtype.value} has no order with {bounds}")
    good, held = F.lit(True), value if text else value.cast("double")
    if feature.min_value is not None:
        good = good & ~(held < F.lit(feature.min_value))
    if feature.max_value is not None:
        good = good & ~(held > F.lit(feature.max_value))
    return value.isNull() | good


def bound_rules(view: FeatureView) -> list[Rule]:
    """One rule for each declared feature with bounds: no value lies outside of them."""
    made = []
    for f in view.features:
        if f.min_value is None and f.max_value is None:
            continue
        low = "" if f.min_value is None else f"{f.min_value} <= "
        high = "" if f.max_value is None else f" <= {f.max_value}"
        made.append(
            Rule(
                f"bounds_{f.name}",
                f"Declared bounds ({low}{f.name}{high})",
                VALIDITY,
                IN_BOUNDS,
                (f.name,),
                lambda f=f: F.count_if(~_within(f)),
                _none,
                _violating,
            )
        )
    return made


def validate_features(df: DataFrame, view: FeatureView) -> DataFrame:
    """Checked and violating values per declared feature, in one scan."""
    present = [f for f in view.features if f.name in df.columns]
    counts = [
        F.struct(
            F.lit(f.name).alias("feature"),
            F.count(F.col(f"`{f.name}`")).alias("checked"),
            F.count_if(~valid(f, df)).alias("violations"),
        )
        for f in present
    ]
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def split_valid(df: DataFrame, view: FeatureView) -> tuple[DataFrame, DataFrame]:
    """Rows whose declared features are all valid, and the others."""
    good = F.lit(True)
    for f in view.features:
        if f.name in df.columns:
            good = good & valid(f, df)
    return df.where(good), df.where(~good)


def rejects(df: DataFrame, view: FeatureView) -> DataFrame:
    """Rows with an invalid value, and in ``reason`` the names of their features that are."""
    named = [F.when(~valid(f, df), F.lit(f.name)) for f in view.features if f.name in df.columns]
    return df.withColumn("reason", F.concat_ws(", ", *named)).where(F.col("reason") != "")


def with_defaults(df: DataFrame, view: FeatureView) -> DataFrame:
    """Declared default values in place of nulls."""
    filled = {
        f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(f.default_value).cast(f.dtype.spark))
        for f in view.features
        if f.default_value is not None and f.name in df.columns
    }
    return df.withColumns(filled)
