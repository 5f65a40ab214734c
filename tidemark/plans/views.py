"""Feature views over the business tables: events, orders, lineitem, embeddings.

They give the generic operators real inputs. Entity keys are ids as text, event times stay
zone-less as in the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import MICROS, epoch_micros, micros_of, moment
from tidemark.operators.drift import BASELINE, CURRENT
from tidemark.operators.pit import ViewData
from tidemark.operators.slicing import SkewPolicy, running_totals
from tidemark.specs import ENTITY_KEY, EVENT_TIME, DataType, Entity, Feature, FeatureView

AS_OF = dt.datetime(2024, 1, 31)
ORDERS_AS_OF = dt.datetime(2001, 9, 1)
DRIFT_SPLIT = dt.datetime(2024, 1, 16)
HOUR_US = 3600 * MICROS
DAY_SECONDS = 86_400
EVENT_TYPES = ("view", "click", "signup", "error", "purchase")
SPINE_DATES = tuple(dt.datetime(y, 1, 1) for y in (1997, 1999, 2001))
NAIVE = T.TimestampNTZType()

F64, I64, BOOL, TEXT = DataType.FLOAT64, DataType.INT64, DataType.BOOLEAN, DataType.STRING

ENTITIES = (
    Entity("user", ("user_id",), "Acting user of an event"),
    Entity("merchant", ("l_suppkey",), "Supplier"),
    Entity("customer", ("o_custkey",), "Ordering customer"),
    Entity("vector", ("vec_id",), "Embedded item"),
)


def event_view(name: str, ttl_seconds: int | None = DAY_SECONDS) -> FeatureView:
    return FeatureView(name, "user", (Feature("value", F64), Feature("k", I64)), ttl_seconds)


EVENT_VIEWS = {f"ev_{kind}": event_view(f"ev_{kind}") for kind in ("view", "click", "error")}

ORDER_VALUE = FeatureView(
    "order_value",
    "customer",
    (Feature("o_totalprice", F64), Feature("o_orderpriority", TEXT)),
    tie="o_orderkey",
)

USER_FRAUD = FeatureView(
    "user_fraud_features",
    "user",
    (
        Feature("tx_count_10m", I64, min_value=0),
        Feature("tx_count_1h", I64, min_value=0),
        Feature("tx_amount_1h", F64),
        Feature("risk_score", F64, min_value=0.0, max_value=1.0),
        Feature("device_trust_score", F64, min_value=0.0, max_value=1.0),
        Feature("is_vpn", BOOL),
        Feature("velocity_ratio", F64),
        Feature("composite_risk", F64),
    ),
    ttl_seconds=DAY_SECONDS,
    transformation_name="fraud_ratios",
)

MERCHANT_RISK = FeatureView(
    "merchant_risk_features",
    "merchant",
    (
        Feature("chargeback_rate", F64, min_value=0.0, max_value=1.0),
        Feature("volume_30d", F64),
        Feature("high_risk_country", BOOL),
        Feature("exposure_score", F64),
    ),
    ttl_seconds=7 * DAY_SECONDS,
    transformation_name="merchant_exposure",
)

CLV = FeatureView(
    "customer_lifetime_value_features",
    "customer",
    (
        Feature("total_orders_count", I64, min_value=1),
        Feature("total_spend_amount", F64, min_value=0.0),
        Feature("churn_probability", F64, min_value=0.0, max_value=1.0),
        Feature("avg_basket_value", F64),
    ),
    ttl_seconds=30 * DAY_SECONDS,
)

VECTORS = FeatureView(
    "vectors",
    "vector",
    (Feature("embedding", DataType.VECTOR), Feature("label", I64, min_value=0, max_value=4)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(column: str) -> Column:
    return F.col(column).cast("string").alias(ENTITY_KEY)


def _k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("long")


def event_history(events: DataFrame, kind: str) -> DataFrame:
    """History of one event type: the value and the ``k`` property."""
    return events.where(F.col("event_type") == kind).select(
        _key("user_id"), F.col("ts").alias(EVENT_TIME), "value", _k().alias("k")
    )


def sparse_history(events: DataFrame) -> DataFrame:
    """View events of which every third lacks its value."""
    return events.where(F.col("event_type") == "view").select(
        _key("user_id"),
        F.col("ts").alias(EVENT_TIME),
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        _k().alias("k"),
    )


def event_views(events: DataFrame) -> dict[str, ViewData]:
    return {
        name: ViewData(view, event_history(events, name.removeprefix("ev_")))
        for name, view in EVENT_VIEWS.items()
    }


def purchase_spine(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "purchase").select(
        _key("user_id"), F.col("ts").alias(EVENT_TIME), "event_id"
    )


def order_history(orders: DataFrame) -> DataFrame:
    return orders.select(
        _key("o_custkey"),
        F.col("o_orderdate").alias(EVENT_TIME),
        "o_orderkey",
        "o_totalprice",
        "o_orderpriority",
    )


def customer_spine(customer: DataFrame) -> DataFrame:
    """Every customer at the start of three years."""
    days = F.array(*[moment(micros_of(day), NAIVE) for day in SPINE_DATES])
    return customer.select(_key("c_custkey"), F.explode(days).alias(EVENT_TIME))


def rolling(
    df: DataFrame,
    key: str,
    at_us: Column,
    sums: dict[str, tuple[int, Column]],
    policy: SkewPolicy | None = None,
) -> DataFrame:
    """Add sums over the last ``width`` microseconds up to and including each row.

    A row adds its amount when it happens and takes it away just after the window has
    passed it, so a rolling sum is a running sum over both kinds of change. Running sums
    work on keys of any size; a window per key would not. Amounts must be exact numbers.
    """
    base = df.select(
        F.col(key).alias("_key"),
        at_us.alias("_at"),
        F.struct("*").alias("_row"),
        *[amount.alias(f"_d_{name}") for name, (_, amount) in sums.items()],
    )
    changes = base
    for width in sorted({w for w, _ in sums.values()}):
        leaving = base.select(
            "_key",
            (F.col("_at") + width + 1).alias("_at"),
            *[
                (-F.col(f"_d_{n}")).cast(base.schema[f"_d_{n}"].dataType).alias(f"_d_{n}")
                for n, (w, _) in sums.items()
                if w == width
            ],
        )
        changes = changes.unionByName(leaving, allowMissingColumns=True)
    totals = {n: F.coalesce(f"_d_{n}", F.lit(0).cast(base.schema[f"_d_{n}"].dataType)) for n in sums}
    summed = running_totals(changes, ["_key"], "_at", totals, policy=policy)
    return summed.where(F.col("_row").isNotNull()).select("_row.*", *sums)


def user_fraud(events: DataFrame, policy: SkewPolicy | None = None) -> DataFrame:
    """Activity of the user over six hours and a day, with risk, trust and VPN flag."""
    one = F.lit(1).cast("long")
    amount = F.col("value").cast("decimal(20,6)")
    active = rolling(
        events.select("event_id", "ts", "user_id", "event_type", "value", _k().alias("k")),
        "user_id",
        epoch_micros(F.col("ts"), events.schema["ts"].dataType),
        {
            "tx_count_10m": (6 * HOUR_US, one),
            "tx_count_1h": (24 * HOUR_US, one),
            "tx_amount_1h": (24 * HOUR_US, amount),
        },
        policy,
    )
    return active.select(
        "event_id",
        _key("user_id"),
        F.col("ts").alias(EVENT_TIME),
        "tx_count_10m",
        "tx_count_1h",
        F.col("tx_amount_1h").cast("double").alias("tx_amount_1h"),
        F.when(F.col("event_id") % 50 != 0, F.col("value") / 400.0).alias("risk_score"),
        (F.lit(1.0) - F.col("k").cast("double") / 100.0).alias("device_trust_score"),
        (F.col("event_type") == "error").alias("is_vpn"),
    )


def merchant_risk(lineitem: DataFrame) -> DataFrame:
    """Per supplier and ship month: share of returns, net volume, country flag."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    net = price * (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    return (
        lineitem.groupBy("l_suppkey", month.alias("month"))
        .agg(
            F.count("*").alias("lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.sum(net).alias("net"),
        )
        .select(
            _key("l_suppkey"),
            F.col("month").cast("timestamp_ntz").alias(EVENT_TIME),
            (F.col("returned") / F.col("lines")).alias("chargeback_rate"),
            F.col("net").cast("double").alias("volume_30d"),
            (F.col("l_suppkey") % 5 == 0).alias("high_risk_country"),
        )
    )


def clv(orders: DataFrame) -> DataFrame:
    """Lifetime value per customer, as of the last order."""
    spend = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        orders.groupBy("o_custkey")
        .agg(
            F.max("o_orderdate").alias(EVENT_TIME),
            F.count("*").alias("total_orders_count"),
            spend.alias("total_spend_amount"),
        )
        .select(
            _key("o_custkey"),
            EVENT_TIME,
            "total_orders_count",
            "total_spend_amount",
            (F.lit(1.0) / (F.lit(1.0) + F.col("total_orders_count") / 10.0)).alias(
                "churn_probability"
            ),
            (F.col("total_spend_amount") / F.col("total_orders_count")).alias("avg_basket_value"),
        )
    )


def vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(_key("vec_id"), "embedding", F.col("label").cast("long").alias("label"))


def drift_sides(events: DataFrame) -> DataFrame:
    """Event values before and after mid-January, one feature per event type."""
    early = F.col("ts") < F.lit(DRIFT_SPLIT.isoformat(sep=" ")).cast("timestamp_ntz")
    return events.select(
        F.col("event_type").alias("feature"),
        F.when(early, F.lit(BASELINE)).otherwise(F.lit(CURRENT)).alias("side"),
        "value",
    )
