import datetime as dt

import pytest
from times import T0, minutes
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import DataType, Entity, Feature, FeatureStore, FeatureView
from tidemark.functions.transforms import RATIO_CALC
from tidemark.operators import quality
from tidemark.sources.history import HistoryTable
from tidemark.specs import Ref, refs_by_view

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 1, 1, 12, 0, 0, tzinfo=UTC)
SKEW_VIEW = FeatureView(
    "skew_test_view",
    "user",
    (Feature("val_a"), Feature("val_b"), Feature("ratio")),
    transformation_name="ratio_calc",
)


@pytest.fixture
def store(spark, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "store"))
    made.register_entity(Entity("user", ("user_id",)))
    made.register_transformation(RATIO_CALC)
    return made


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_references_split_at_the_first_colon():
    assert Ref.parse("v:a:b") == ("v", "a:b")
    assert Ref.parse("a") == ("default", "a")
    assert refs_by_view(["q:x", "p:y", "q:z", "q:x"]) == {"q": ["x", "z"], "p": ["y"]}


def test_specs_are_checked(store):
    with pytest.raises(ValueError):
        store.register_feature_view(FeatureView("v", "nobody", (Feature("a"),)))
    with pytest.raises(ValueError):
        FeatureView("v", "user", (Feature("a"),), ttl_seconds=0)
    with pytest.raises(ValueError):
        FeatureView("v", "user", (Feature("entity_key"),))
    with pytest.raises(ValueError):
        store.register_feature_view(FeatureView("v", "user", (Feature("a"),), transformation_name="nope"))
    with pytest.raises(ValueError):
        store.ingest_batch("unknown", None)
    names = ["Bool", "boolean", "int64", "weird"]
    assert [DataType.parse(n) for n in names] == [DataType.BOOLEAN, DataType.BOOLEAN, DataType.INT64, DataType.FLOAT64]


def test_served_values_equal_history(spark, store):
    store.register_feature_view(SKEW_VIEW)
    data = [(f"user_{i}", NOW - dt.timedelta(seconds=100 - i), 10.0 + i, 2.0 + i % 5) for i in range(50)]
    store.ingest_batch("skew_test_view", rows(spark, data, "entity_key string, event_timestamp timestamp, val_a double, val_b double"))
    refs = [f"skew_test_view:{f}" for f in ("val_a", "val_b", "ratio")]
    requests = rows(spark, [(f"user_{i}",) for i in range(50)], "entity_key string")
    served = store.get_online_features(requests, refs, now=NOW)
    by_key = {r.entity_key: r for r in served.collect()}
    logged = {r.inference_id: r.entity_key for r in store.inferences.read().collect()}
    assert logged == {r.inference_id: r.entity_key for r in by_key.values()}
    assert by_key["user_7"]["skew_test_view:ratio"] == round(17.0 / 4.0, 4)
    report = store.verify_skew(refs)
    assert tuple(report.summary.first()) == (150, 150, 0, 0.0, 100.0)
    assert report.mismatches.count() == 0
    drift = {r.feature: r for r in report.drift.collect()}
    assert set(drift) == set(refs) and all(r.status == "NORMAL" and r.psi == 0.0 for r in drift.values())


def test_changed_history_is_found(spark, store):
    view = FeatureView("test_fv", "user", (Feature("score"),))
    store.register_feature_view(view)
    schema = "entity_key string, event_timestamp timestamp, score double"
    store.ingest_batch("test_fv", rows(spark, [("u_1", NOW - dt.timedelta(seconds=60), 10.0)], schema))
    store.get_online_features(rows(spark, [("u_1",)], "entity_key string"), ["test_fv:score"], now=NOW)
    store.history("test_fv").append(rows(spark, [("u_1", NOW - dt.timedelta(seconds=30), 99.0)], schema))
    report = store.verify_skew(["test_fv:score"])
    assert tuple(report.summary.first()) == (1, 0, 1, 100.0, 0.0)
    row = report.mismatches.first()
    assert (row.entity_key, row.feature, row.online_num, row.offline_num) == ("u_1", "test_fv:score", 10.0, 99.0)


def test_no_log_means_no_skew(store):
    store.register_feature_view(SKEW_VIEW)
    report = store.verify_skew()
    assert tuple(report.summary.first()) == (0, 0, 0, 0.0, 100.0)
    assert {r.status for r in report.drift.collect()} == {"TOO_FEW_VALUES"}


def test_ingest_casts_fills_and_evolves(spark, tmp_path):
    view = FeatureView("v", "user", (Feature("a"), Feature("n", DataType.INT64), Feature("flag", DataType.BOOLEAN)))
    table = HistoryTable(spark, str(tmp_path / "v"), view, T.TimestampNTZType())
    assert table.read().count() == 0 and table.read(evolved=True).count() == 0 and table.count() == 0
    assert table.timeline("u").count() == 0
    table.append(rows(spark, [(1, "2026-01-01 12:00:00", "1.5", "x", True)], "entity_key long, event_timestamp string, a string, n string, flag boolean").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp_ntz")), "1")
    table.append(rows(spark, [("1", minutes(1), float("nan"), "new")], "entity_key string, event_timestamp timestamp_ntz, a double, extra string"), "2")
    table.append(rows(spark, [], "entity_key string, event_timestamp timestamp_ntz, a double"), "3")
    first, second = table.timeline("1").collect()
    assert (first.a, first.n, first.flag, second.a, second.n) == (1.5, None, True, None, None)
    assert first.created_timestamp is not None
    grown = {r.event_timestamp: r.extra for r in table.read(evolved=True).collect()}
    assert grown == {T0: None, minutes(1): "new"}


def test_writing_a_batch_again_replaces_it(spark, store):
    store.register_feature_view(SKEW_VIEW)
    data = rows(spark, [("u", NOW, 1.0, 2.0)], "entity_key string, event_timestamp timestamp, val_a double, val_b double")
    for _ in range(2):
        store.ingest_batch("skew_test_view", data, batch="7")
    assert store.history("skew_test_view").count() == 1
    assert store.state("skew_test_view").read().first().ratio.value == 0.5


def test_compaction_keeps_rows_and_passes_replays_over(spark, store, tmp_path):
    store.register_feature_view(SKEW_VIEW)
    schema = "entity_key string, event_timestamp timestamp, val_a double, val_b double"
    parts = [rows(spark, [("u", NOW - dt.timedelta(days=d), float(i), 2.0) for d in range(3)], schema) for i in range(4)]
    for i, part in enumerate(parts):
        store.ingest_batch("skew_test_view", part, batch=f"s-{i:020d}")
    before = sorted(map(str, store.history("skew_test_view").read().collect()))
    state = sorted(map(str, store.state("skew_test_view").read().collect()))
    for _ in range(2):
        store.compact()
        (batch,) = store.history("skew_test_view").folder.seen().visible
        files = list((tmp_path / "store" / "history" / "skew_test_view" / f"batch={batch}").glob("*.parquet"))
        assert len(files) == 1
        store.ingest_batch("skew_test_view", parts[1], batch=f"s-{1:020d}")
        assert sorted(map(str, store.history("skew_test_view").read().collect())) == before
        assert sorted(map(str, store.state("skew_test_view").read().collect())) == state
    store.ingest_batch("skew_test_view", parts[1], batch="new")
    assert store.history("skew_test_view").count() == len(before) + 3


def test_conflicting_columns_keep_their_first_type(spark, store):
    view = FeatureView("v", "user", (Feature("a"),))
    store.register_feature_view(view)
    schema = "entity_key string, event_timestamp timestamp, a double, x {}"
    store.ingest_batch("v", rows(spark, [("u", NOW, 1.0, 5)], schema.format("int")))
    store.ingest_batch("v", rows(spark, [("u", NOW, 2.0, "7"), ("u", NOW, 3.0, "no")], schema.format("string")))
    got = {r.a: r.x for r in store.history("v").read(evolved=True).collect()}
    assert got == {1.0: 5, 2.0: 7, 3.0: None}


def test_dates_outside_the_reach_of_the_spine_are_not_read(spark, store):
    view = FeatureView("v", "user", (Feature("a"),), ttl_seconds=3600)
    store.register_feature_view(view)
    schema = "entity_key string, event_timestamp timestamp, a double"
    store.ingest_batch("v", rows(spark, [("u", NOW - dt.timedelta(days=d), float(d)) for d in range(30)], schema))
    spine = rows(spark, [("u", NOW - dt.timedelta(days=10) + dt.timedelta(minutes=5))], "entity_key string, event_timestamp timestamp")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    joined = store.get_historical_features(spine, ["v:a"])
    assert joined.first()["v:a"] == 10.0
    plan = joined._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [line for line in plan.splitlines() if "PushedFilters" in line and "event_date" in line]
    assert filters and all("GreaterThanOrEqual(event_date,2025-12-21)" in f and "LessThanOrEqual(event_date,2025-12-23)" in f for f in filters)


def test_routing_flags_and_backfill(spark, store):
    schema = "entity_key string, event_timestamp timestamp, a double"
    data = [("u", NOW, None), ("u", NOW - dt.timedelta(1), 1.0), ("w", NOW, 2.0)]
    for name, online, offline in (("both", True, True), ("offline", False, True), ("online", True, False)):
        store.register_feature_view(FeatureView(name, "user", (Feature("a"),), online=online, offline=offline))
        store.ingest_batch(name, rows(spark, data, schema), sync_to_online=name != "both")
    assert store.history("online").count() == 0 and store.state("offline").read().count() == 0
    assert {r.entity_key: r.a.value for r in store.state("online").read().collect()} == {"u": 1.0, "w": 2.0}
    report = store.backfill()
    assert [(r.feature_view, r.synced_records) for r in report.collect()] == [("both", 2)]
    cells = {r.entity_key: r.a for r in store.state("both").read().collect()}
    assert cells["u"] is None and cells["w"].value == 2.0
    counts = {r.feature_view: (r.row_count, r.state_keys) for r in store.get_telemetry().collect()}
    assert counts == {"both": (3, 2), "offline": (3, 0), "online": (0, 2)}
    assert [r.action for r in store.audit.recent(100).collect()] == ["BACKFILL_SYNC"]


def test_dataset_generation(spark, store, tmp_path):
    store.register_feature_view(FeatureView("v", "user", (Feature("a"),), ttl_seconds=6 * 3600))
    schema = "entity_key string, event_timestamp timestamp, a double"
    store.ingest_batch("v", rows(spark, [("u", NOW - dt.timedelta(hours=9), 1.0), ("u", NOW - dt.timedelta(hours=4), 2.0)], schema))
    entities = rows(spark, [("u",), ("w",)], "entity_key string")
    path = str(tmp_path / "csv")
    made = store.generate_dataset(entities, ["v:a"], 3, now=NOW, csv_path=path)
    got = {(r.entity_key, r.event_timestamp.timestamp()): r["v:a"] for r in made.rows.collect()}
    hours = lambda h: (NOW - dt.timedelta(hours=h)).timestamp()
    assert got == {("u", hours(12)): None, ("u", hours(8)): 1.0, ("u", hours(4)): 2.0, ("w", hours(12)): None, ("w", hours(8)): None, ("w", hours(4)): None}
    assert tuple(made.summary.first()) == (6, 1)
    assert made.sample.count() == 6 and made.sample.first().event_timestamp.startswith("2026-01-01T00:00:00")
    assert spark.read.option("header", True).csv(path).count() == 6
    inside = store.generate_dataset(entities, ["v:a"], 3, now=NOW, start=NOW - dt.timedelta(hours=8))
    assert inside.rows.count() == 4


def test_time_travel_and_entity_views(spark, store):
    store.register_feature_view(FeatureView("v", "user", (Feature("a"),)))
    schema = "entity_key string, event_timestamp timestamp, a double"
    store.ingest_batch("v", rows(spark, [("u", NOW + dt.timedelta(minutes=i), float(i)) for i in range(4)] + [("w", NOW, 9.0)], schema))
    got = store.time_travel("u", "v").orderBy("event_timestamp").collect()
    assert [(r["v:a"], r.hidden_updates) for r in got] == [(0.0, 3), (1.0, 2), (2.0, 1), (3.0, 0)]
    assert [r.a for r in store.get_timeline("u", "v").collect()] == [0.0, 1.0, 2.0, 3.0]
    assert [(r.feature, r.num) for r in store.get_entity_all("u").collect()] == [("a", 3.0)]
    assert {r.status for r in store.freshness(NOW).collect()} == {"FRESH"}


def test_quality_of_a_store(spark, store):
    view = FeatureView("v", "user", (Feature("risk_score"), Feature("n", DataType.INT64)))
    store.register_feature_view(view)
    schema = "entity_key string, event_timestamp timestamp, risk_score double, n long"
    store.ingest_batch("v", rows(spark, [("u", NOW, 0.5, 1), ("u", NOW, None, -1), ("w", NOW, 1.5, 0)], schema))
    rules = [
        quality.not_null("nulls", "Nulls", "risk_score"),
        quality.in_range("range", "Range", "risk_score", 0.0, 1.0),
        quality.not_negative("counts", "Counts", "n"),
        quality.in_range("gone", "Gone", "no_such_column", 0.0, 1.0),
    ]
    latencies = rows(spark, [(0.1,), (0.2,), (0.9,)], "latency_ms double")
    table = store.validate_quality({"v": rules}, parity_refs=["v:risk_score"], latencies=latencies)
    got = {r.rule_id: r for r in table.collect()}
    assert {k: r.passed for k, r in got.items()} == {
        "schema_columns_v": True, "nulls": False, "range": False, "counts": False, "gone": False,
        "zero_skew_guarantee": True, "serving_latency_sla": True,
    }
    assert got["nulls"].observed == "1 nulls out of 3 rows (33.33%)"
    assert got["range"].observed == "1 violating rows"
    assert got["serving_latency_sla"].observed == "p50 = 0.200 ms, p99 = 0.900 ms"
    assert got["zero_skew_guarantee"].observed == "0.0000% skew across 0 checked values"
    assert tuple(quality.quality_score(table).first()) == (7, 3, 4, 42.9, "WARNING")
    good = quality.check_table(store.history("v").read(), [quality.in_range("x", "X", "n", -5, 5)])
    assert quality.quality_score(good).first().status == "PASSED"


def test_scores_of_latest_and_past_features(spark, store):
    from tidemark.plans import views as V
    from tidemark.functions.transforms import FRAUD_RATIOS

    store.register_transformation(FRAUD_RATIOS)
    store.register_feature_view(V.USER_FRAUD)
    data = [("u", NOW, 4, 8, 100.0, 0.9, 0.2, True)]
    schema = "entity_key string, event_timestamp timestamp, tx_count_10m long, tx_count_1h long, tx_amount_1h double, risk_score double, device_trust_score double, is_vpn boolean"
    store.ingest_batch("user_fraud_features", rows(spark, data, schema))
    requests = rows(spark, [("u",), ("nobody",)], "entity_key string")
    got = {r.entity_key: r for r in store.predict(requests, "fraud_sentinel_v2", now=NOW).collect()}
    assert got["u"]["user_fraud_features:composite_risk"] == 0.81
    assert got["u"].decision == "DECLINED" and got["nobody"].decision == "APPROVED"
    spine = rows(spark, [("u", NOW)], "entity_key string, event_timestamp timestamp")
    assert store.score_history(spine, "fraud_sentinel_v2").first().probability_score == got["u"].probability_score
    with pytest.raises(ValueError):
        store.predict(requests, "no_such_model")
