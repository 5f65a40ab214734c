"""A registry that outlives the session, and what scorers recommend."""

import pytest

from tidemark import DataType, Entity, Feature, FeatureStore, FeatureView
from tidemark.functions.scoring import ACTIONS, MODELS, with_actions


def test_registry_comes_back(spark, tmp_path):
    store = FeatureStore(spark, f"{tmp_path}/s")
    store.register_entity(Entity("pair", ("a", "b"), "two keys"))
    store.save_registry()
    view = FeatureView(
        "v",
        "pair",
        (
            Feature("x", DataType.INT64, "number", 3, 0, 9.5),
            Feature("t", DataType.STRING, default_value="é'\"", min_value="a"),
            Feature("w", DataType.VECTOR, default_value=[1.0, 2.0]),
        ),
        ttl_seconds=60,
        online=False,
        tie="no",
        extra="more",
    )
    store.register_feature_view(view)
    store.save_registry()
    again = FeatureStore.open(spark, f"{tmp_path}/s")
    assert again.registry == store.registry
    assert again.registry.view("v") == view and again.registry.entities["pair"].join_keys == ("a", "b")


def test_nothing_saved(spark, tmp_path):
    with pytest.raises(ValueError, match="no registry"):
        FeatureStore.open(spark, f"{tmp_path}/none")
    empty = FeatureStore(spark, f"{tmp_path}/empty")
    empty.save_registry()
    assert FeatureStore.open(spark, f"{tmp_path}/empty").registry == empty.registry


def test_every_decision_has_its_action(spark):
    decisions = {label for m in MODELS.values() for _, label in m.ladder} | {m.otherwise for m in MODELS.values()}
    assert decisions == set(ACTIONS)
    rows = [(d, 0.1234) for d in sorted(decisions)] + [(None, None), ("OTHER", 0.5)]
    got = with_actions(spark.createDataFrame(rows, "decision string, probability_score double")).collect()
    for r in got:
        badge, action = ACTIONS.get(r.decision, (None, None))
        assert (r.decision_badge, r.action_recommendation) == (badge, action)
        assert r.probability_percent == ("12.3%" if badge else None)
