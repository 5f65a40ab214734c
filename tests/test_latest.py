import datetime as dt

import pytest
from times import T0, minutes

from tidemark.operators import latest
from tidemark.operators.latest import ViewState
from tidemark.operators.slicing import SkewPolicy
from tidemark.sources.state import StateTable
from tidemark.specs import DataType, Feature, FeatureView
from pyspark.sql import types as T

VIEW = FeatureView("user_view", "user", (Feature("f1", DataType.INT64), Feature("f2", DataType.STRING)))
HISTORY = "entity_key string, event_timestamp timestamp_ntz, f1 long, f2 string"


def state(spark, rows, view=VIEW):
    return ViewState(view, latest.latest_values(spark.createDataFrame(rows, HISTORY), view))


def test_values_and_rows_differ_on_nulls(spark):
    rows = [("u", minutes(1), 1, "a"), ("u", minutes(2), None, "b"), ("w", minutes(1), None, None)]
    df = spark.createDataFrame(rows, HISTORY)
    newest = {r.entity_key: r for r in latest.latest_row(df, VIEW).collect()}
    assert (newest["u"].f1, newest["u"].f2) == (None, "b")
    values = {r.entity_key: r for r in latest.latest_values(df, VIEW).collect()}
    assert (values["u"].f1.value, values["u"].f1.ts) == (1, minutes(1))
    assert (values["u"].f2.value, values["u"].f2.ts) == ("b", minutes(2))
    assert values["w"].f1 is None


def test_latest_row_is_limited_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.createDataFrame([("u", minutes(1), 1, "a")], HISTORY).write.parquet(path)
    plan = latest.latest_row(spark.read.parquet(path), VIEW)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_lookup_keeps_request_order_duplicates_and_unknown_keys(spark):
    states = {"user_view": state(spark, [(f"user_{i}", T0, i, f"s{i}") for i in range(100)])}
    keys = [f"user_{i}" for i in range(50)] + ["user_3", "nobody", None]
    requests = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "entity_key string, n long")
    for policy in (None, SkewPolicy(rows_per_slice=1)):
        got = latest.lookup(requests, states, ["user_view:f1", "user_view:f2"], T0, policy).orderBy("n").collect()
        assert [r.entity_key for r in got] == keys
        assert [r["user_view:f1"] for r in got] == [*range(50), 3, None, None]
        assert got[7]["user_view:f2"] == "s7"


def test_ttl_expires_each_feature_by_its_own_time(spark):
    view = FeatureView("user_view", "user", VIEW.features, ttl_seconds=2)
    at = lambda s: T0 - dt.timedelta(seconds=s)
    rows = [("old", at(5), 100, None), ("new", at(0), 200, None), ("edge", at(2), 1, None), ("mixed", at(5), 1, "x"), ("mixed", at(1), 2, None)]
    requests = spark.createDataFrame([("old",), ("new",), ("edge",), ("mixed",)], "entity_key string")
    got = {r.entity_key: tuple(r)[1:] for r in latest.lookup(requests, {"user_view": state(spark, rows, view)}, ["user_view:f1", "user_view:f2"], T0).collect()}
    assert got == {"old": (None, None), "new": (200, None), "edge": (1, None), "mixed": (2, None)}


def test_lookup_checks_references(spark):
    requests = spark.createDataFrame([("u",)], "entity_key string")
    with pytest.raises(ValueError):
        latest.lookup(requests, {}, ["user_view:f1"], T0)
    empty = {"user_view": ViewState(VIEW, None)}
    row = latest.lookup(requests, empty, ["user_view:f1"], T0).first()
    assert row["user_view:f1"] is None


def test_upserts_merge_feature_by_feature_and_late_events_lose(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "s"), VIEW, T.TimestampNTZType())
    assert table.read().count() == 0
    table.upsert(state(spark, [("u", minutes(5), 1, "a")]).data, "1")
    table.upsert(state(spark, [("u", minutes(6), 2, None), ("w", minutes(1), 9, None)]).data, "2")
    table.upsert(state(spark, [("u", minutes(4), 3, "late")]).data, "3")
    table.upsert(state(spark, [("u", minutes(4), 3, "late")]).data, "3")
    table.upsert(state(spark, [("w", minutes(1), 10, None)]).data, "4")
    rows = {r.entity_key: r for r in table.read().collect()}
    assert (rows["u"].f1.value, rows["u"].f2.value) == (2, "a")
    assert rows["w"].f1.value == 10
    table.compact()
    assert sorted(map(str, table.read().collect())) == sorted(map(str, rows.values()))
    table.upsert(state(spark, [("w", minutes(2), 11, None)]).data, "1")
    assert {r.entity_key: r.f1.value for r in table.read().collect()} == {"u": 2, "w": 11}
    table.replace(state(spark, [("x", minutes(0), 1, None)]).data)
    assert [r.entity_key for r in table.read().collect()] == ["x"]


def test_state_breaks_ties_as_history_does(spark, tmp_path):
    view = FeatureView("user_view", "user", VIEW.features, tie="n")
    schema = "entity_key string, event_timestamp timestamp_ntz, created_timestamp timestamp_ntz, n long, f1 long"
    made = [("u", T0, minutes(2), 1, 1), ("u", T0, minutes(1), 9, 2), ("u", T0, minutes(2), 0, 3)]
    for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
        table = StateTable(spark, str(tmp_path / f"s{order}"), view, T.TimestampNTZType())
        for i, name in zip(order, ("view-00000000000000000001", "7", "z")):
            rows = spark.createDataFrame([made[i]], schema)
            table.upsert(latest.latest_values(rows, view), name)
        assert table.read().first().f1.value == 1


def test_entity_all_lists_known_features_of_every_view(spark):
    other = FeatureView("other", "user", VIEW.features)
    states = {"user_view": state(spark, [("u", T0, 1, None)]), "other": state(spark, [("u", T0, None, "z"), ("w", T0, 5, "q")], other)}
    got = {(r.feature_view, r.feature): (r.num, r.text) for r in latest.entity_all(states, "u").collect()}
    assert got == {("user_view", "f1"): (1.0, None), ("other", "f2"): (None, "z")}


def test_freshness(spark):
    view = FeatureView("user_view", "user", VIEW.features, ttl_seconds=100)
    ages = {"a": 10, "b": 81, "c": 100, "d": 101}
    rows = [(k, T0 - dt.timedelta(seconds=s), 1, None) for k, s in ages.items()]
    got = {r.entity_key: r for r in latest.freshness({"v": state(spark, rows, view)}, T0).collect()}
    assert [got[k].status for k in "abcd"] == ["FRESH", "EXPIRING_SOON", "EXPIRING_SOON", "EXPIRED"]
    assert (got["b"].age_seconds, got["b"].ttl_remaining_seconds, got["b"].feature_count) == (81.0, 19.0, 1)
    assert got["d"].ttl_remaining_seconds == 0.0
    endless = latest.freshness({"v": state(spark, rows)}, T0).collect()
    assert {(r.status, r.ttl_remaining_seconds) for r in endless} == {("FRESH", None)}
