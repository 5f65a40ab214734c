"""Scoring of feature rows in bulk: probability, decision and contributions as columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numerics import clamp, default_if_empty, round_even, sigmoid

RISK, SAFE = "risk", "safe"


@dataclass(frozen=True)
class Contribution:
    """How one feature enters a score: its share and whether it counts as a risk."""

    feature: str
    value: Column
    impact: Column
    risky: Column
    shown: Column | None = None

    def column(self) -> Column:
        return F.struct(
            F.lit(self.feature).alias("feature"),
            self.value.cast("double").alias("value"),
            (F.lit(None).cast("string") if self.shown is None else self.shown).alias("shown"),
            self.impact.alias("impact"),
            F.when(self.risky, F.lit(RISK)).otherwise(F.lit(SAFE)).alias("direction"),
        )


@dataclass(frozen=True)
class Score:
    probability: Column
    contributions: list[Contribution]


@dataclass(frozen=True)
class Model:
    """The features a scorer reads, its formula, and its decisions from high to low."""

    model_id: str
    view: str
    features: tuple[str, ...]
    formula: Callable[[dict[str, Column]], Score]
    ladder: tuple[tuple[float, str], ...]
    otherwise: str

    @property
    def refs(self) -> list[str]:
        return [f"{self.view}:{f}" for f in self.features]

    def decide(self, probability: Column) -> Column:
        decision = F
        for floor, label in self.ladder:
            decision = decision.when(probability >= floor, F.lit(label))
        return decision.otherwise(F.lit(self.otherwise))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", round_even(value, digits))


def _percent(value: Column, sign: str = "") -> Column:
    return F.concat(F.lit(sign), fixed(value, 1), F.lit("%"))


def _money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(round_even(value, 2), 2))


def _flag(value: Column) -> Column:
    return F.coalesce(value.cast("boolean"), F.lit(False))


def _flag_text(value: Column) -> Column:
    return F.when(value, F.lit("True")).otherwise(F.lit("False"))


def _logistic(z: Column) -> Column:
    return round_even(sigmoid(clamp(z, -10.0, 10.0)), 4)


# Defaults, weights, thresholds and labels of the three scorers.
def _fraud(c: dict[str, Column]) -> Score:
    risk = default_if_empty(c["composite_risk"], 0.15)
    count = default_if_empty(c["tx_count_10m"], 1)
    amount = default_if_empty(c["tx_amount_1h"], 50)
    trust = default_if_empty(c["device_trust_score"], 0.9)
    vpn = _flag(c["is_vpn"])
    z = (
        F.lit(2.8) * risk
        + F.lit(0.12) * count
        + F.lit(0.0006) * amount
        - F.lit(1.9) * trust
        + F.when(vpn, F.lit(1.2)).otherwise(F.lit(-0.3))
        - F.lit(0.4)
    )
    never = F.lit(False)
    sign = F.when(risk > 0.3, F.lit("+")).otherwise(F.lit(""))
    return Score(
        _logistic(z),
        [
            Contribution("composite_risk", risk, F.concat(sign, _percent(risk * 45)), risk > 0.3),
            Contribution("tx_count_10m", count, _percent(count * F.lit(4.2), "+"), count > 3),
            Contribution(
                "tx_amount_1h",
                amount,
                _percent(amount * F.lit(0.04), "+"),
                amount > 200,
                F.concat(F.lit("$"), fixed(amount, 2)),
            ),
            Contribution("device_trust_score", trust, _percent(trust * 35, "-"), never),
            Contribution(
                "is_vpn",
                vpn,
                F.when(vpn, F.lit("+25.0%")).otherwise(F.lit("0.0%")),
                vpn,
                _flag_text(vpn),
            ),
        ],
    )


def _merchant(c: dict[str, Column]) -> Score:
    rate = default_if_empty(c["chargeback_rate"], 0.01)
    exposure = default_if_empty(c["exposure_score"], 1.5)
    volume = default_if_empty(c["volume_30d"], 50000)
    country = _flag(c["high_risk_country"])
    z = (
        F.lit(42.0) * rate
        + F.lit(0.12) * exposure
        + F.when(country, F.lit(1.6)).otherwise(F.lit(-0.5))
        - F.lit(1.2)
    )
    return Score(
        _logistic(z),
        [
            Contribution(
                "chargeback_rate",
                rate,
                _percent(rate * 250, "+"),
                rate > 0.015,
                F.concat(fixed(rate * 100, 2), F.lit("%")),
            ),
            Contribution(
                "exposure_score", exposure, _percent(exposure * F.lit(6.5), "+"), exposure > 3.0
            ),
            Contribution("volume_30d", volume, F.lit("Baseline"), F.lit(False), _money(volume)),
            Contribution(
                "high_risk_country",
                country,
                F.when(country, F.lit("+30.0%")).otherwise(F.lit("0.0%")),
                country,
                _flag_text(country),
            ),
        ],
    )


def _churn(c: dict[str, Column]) -> Score:
    churn = default_if_empty(c["churn_probability"], 0.25)
    orders = default_if_empty(c["total_orders_count"], 10)
    spend = default_if_empty(c["total_spend_amount"], 500)
    basket = default_if_empty(c["avg_basket_value"], 50)
    never = F.lit(False)
    return Score(
        round_even(churn, 4),
        [
            Contribution(
                "churn_probability",
                churn,
                _percent(churn * 60, "+"),
                churn > 0.3,
                _percent(churn * 100),
            ),
            Contribution("total_orders_count", orders, _percent(orders * F.lit(0.8), "-"), never),
            Contribution(
                "total_spend_amount", spend, _percent(spend * F.lit(0.015), "-"), never, _money(spend)
            ),
            Contribution(
                "avg_basket_value",
                basket,
                F.lit("Neutral"),
                never,
                F.concat(F.lit("$"), fixed(basket, 2)),
            ),
        ],
    )


MODELS = {
    m.model_id: m
    for m in (
        Model(
            "fraud_sentinel_v2",
            "user_fraud_features",
            ("composite_risk", "tx_count_10m", "tx_amount_1h", "device_trust_score", "is_vpn"),
            _fraud,
            ((0.65, "DECLINED"), (0.35, "CHALLENGE_2FA")),
            "APPROVED",
        ),
        Model(
            "merchant_underwriter_v1",
            "merchant_risk_features",
            ("chargeback_rate", "exposure_score", "volume_30d", "high_risk_country"),
            _merchant,
            ((0.60, "TIER_3_RESTRICTED"), (0.30, "TIER_2_MONITORED")),
            "TIER_1_PRIME",
        ),
        Model(
            "churn_predictor_v3",
            "customer_lifetime_value_features",
            (
                "churn_probability",
                "total_orders_count",
                "total_spend_amount",
                "avg_basket_value",
            ),
            _churn,
            ((0.50, "HIGH_CHURN_RISK"), (0.25, "MODERATE_ENGAGEMENT")),
            "LOYAL_CUSTOMER",
        ),
    )
}


def model(model_id: str) -> Model:
    try:
        return MODELS[model_id]
    except KeyError:
        raise ValueError(f"unknown model {model_id!r}") from None


def score(df: DataFrame, model_id: str, *, prefix: str | None = None) -> DataFrame:
    """Add ``probability_score``, ``decision`` and ``contributions`` to feature rows.

    Features are read from columns ``view:feature`` as joins and lookups produce them, or
    from plain feature columns if ``prefix`` is an empty string. Works on streams too.
    """
    chosen = model(model_id)
    lead = f"{chosen.view}:" if prefix is None else prefix
    missing = [f for f in chosen.features if f"{lead}{f}" not in df.columns]
    if missing:
        raise ValueError(f"model {model_id!r} needs columns {missing}")
    made = chosen.formula({f: F.col(f"`{lead}{f}`") for f in chosen.features})
    scored = df.withColumn("probability_score", made.probability)
    return scored.withColumns(
        {
            "decision": chosen.decide(F.col("probability_score")),
            "contributions": F.array(*[c.column() for c in made.contributions]),
        }
    )


# What is recommended and shown for each decision.
ACTIONS = {
    "DECLINED": ("danger", "Block transaction immediately; alert fraud ops center."),
    "CHALLENGE_2FA": ("warning", "Trigger step-up biometric / SMS authentication challenge."),
    "APPROVED": ("success", "Instant settlement approved under zero-friction SLA."),
    "TIER_3_RESTRICTED": ("danger", "Place 14-day rolling reserve on merchant settlements."),
    "TIER_2_MONITORED": ("warning", "Standard settlement with daily volume velocity caps."),
    "TIER_1_PRIME": ("success", "Instant accelerated next-day settlement eligible."),
    "HIGH_CHURN_RISK": ("danger", "Dispatch personalized 25% retention incentive credit."),
    "MODERATE_ENGAGEMENT": ("warning", "Enroll in weekly curated product recommendation digest."),
    "LOYAL_CUSTOMER": ("success", "VIP customer status. Eligible for early access concierge."),
}


def with_actions(scored: DataFrame) -> DataFrame:
    """Add ``decision_badge``, ``action_recommendation`` and ``probability_percent`` to scored rows.

    All are null where the decision is null or none of the scorers'.
    """
    badge = action = F
    for decision, (shown, text) in ACTIONS.items():
        badge = badge.when(F.col("decision") == decision, F.lit(shown))
        action = action.when(F.col("decision") == decision, F.lit(text))
    known = F.col("decision").isin(*ACTIONS)
    return scored.withColumns(
        {
            "decision_badge": badge,
            "action_recommendation": action,
            "probability_percent": F.when(known, _percent(F.col("probability_score") * 100)),
        }
    )


def explode_contributions(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per score and feature."""
    return scored.select(*keys, F.inline("contributions"))
