"""Compaction, backfill and retention beside batches that land while they run."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark import Entity, Feature, FeatureStore, FeatureView
from tidemark.sources.batches import BatchFolder
from tidemark.sources.logs import LogTable
from tidemark.streaming.ingest import stream_totals

NOW = dt.datetime(2026, 1, 1, 12, 0, 0, tzinfo=dt.timezone.utc)
SCHEMA = "entity_key string, event_timestamp timestamp, a double"


@pytest.fixture
def store(spark, tmp_path):
    made = FeatureStore(spark, str(tmp_path / "store"))
    made.register_entity(Entity("user", ("user_id",)))
    made.register_feature_view(FeatureView("v", "user", (Feature("a"),)))
    return made


def put(spark, store, key, value, batch, minute=0):
    row = [(key, NOW + dt.timedelta(minutes=minute), value)]
    store.ingest_batch("v", spark.createDataFrame(row, SCHEMA), batch=batch)


def keys(store):
    """Rows of history and of the state."""
    held = sorted((r.entity_key, r.a) for r in store.history("v").read().collect())
    return held, sorted((r.entity_key, r.a.value) for r in store.state("v").read().collect())


def before_publish(monkeypatch, act):
    """``act`` once, between what a change writes and its publication."""
    plain, done = BatchFolder.publish, []

    def publish(self, *args, **options):
        if not done:
            done.append(1)
            act()
        plain(self, *args, **options)

    monkeypatch.setattr(BatchFolder, "publish", publish)


@pytest.mark.parametrize("act", ["compact", "backfill"])
def test_a_batch_that_lands_during_a_change_stays(spark, store, monkeypatch, act):
    put(spark, store, "a", 1.0, "1")
    before_publish(monkeypatch, lambda: put(spark, store, "b", 2.0, "2"))
    getattr(store, act)()
    assert keys(store) == ([("a", 1.0), ("b", 2.0)],) * 2
    getattr(store, act)()
    put(spark, store, "b", 2.0, "2")
    assert keys(store) == ([("a", 1.0), ("b", 2.0)],) * 2


def test_two_compactions_at_once(spark, store, monkeypatch):
    for i in range(3):
        put(spark, store, f"k{i}", float(i), str(i))
    want = keys(store)
    before_publish(monkeypatch, store.history("v").compact)
    store.history("v").compact()
    assert keys(store) == want and len(store.history("v").folder.seen().visible) == 1
    store.history("v").compact()
    assert keys(store) == want and len(store.history("v").folder.seen().visible) == 1


def test_a_backfill_wins_over_a_compaction_beside_it(spark, store, monkeypatch):
    put(spark, store, "a", 1.0, "1")
    put(spark, store, "a", None, "2", minute=1)

    def beside():
        put(spark, store, "b", 3.0, "3")
        store.state("v").compact()

    before_publish(monkeypatch, beside)
    store.backfill()
    # The older value that the newest row lacks is gone; the late delta is not.
    cells = {r.entity_key: r.a for r in store.state("v").read().collect()}
    assert cells["a"] is None and cells["b"].value == 3.0


def test_a_change_that_was_never_published_is_not_seen(spark, store):
    put(spark, store, "a", 1.0, "1")
    table = store.history("v")
    table._write(table.read(), table.folder.output())
    assert table.count() == 1


def test_digits_with_leading_zeros_stay_names(spark, store):
    for i in range(2):
        put(spark, store, "a", float(i), f"{i:020d}", minute=i)
    store.compact()
    put(spark, store, "a", 0.0, f"{0:020d}")
    assert store.history("v").count() == 2
    assert store.history("v").folder.seen().hidden == {f"{i:020d}" for i in range(2)}


def test_totals_of_a_stream_survive_compaction(spark, store):
    for i in range(3):
        put(spark, store, f"k{i}", 1.0, f"s-{i:020d}")
    first = tuple(stream_totals(store.history("v"), "s").first())
    assert first[:2] == (3, 3) and first[3] == 2
    for _ in range(2):
        store.compact()
        assert tuple(stream_totals(store.history("v"), "s").first()) == first
    put(spark, store, "k9", 1.0, f"s-{3:020d}")
    assert tuple(stream_totals(store.history("v"), "s").first())[:2] == (4, 4)


def test_many_dates_make_few_files(spark, store, tmp_path):
    days = spark.range(2000).selectExpr(
        "cast(id % 7 as string) as entity_key", "timestamp '2020-01-01' + make_dt_interval(cast(id as int)) as event_timestamp", "1D as a"
    )
    store.ingest_batch("v", days, batch="1")
    assert len(list((tmp_path / "store" / "history" / "v").glob("**/*.parquet"))) <= 8


def test_tables_without_changes_run_no_job_to_find_their_batches(spark, store):
    put(spark, store, "a", 1.0, "1")
    folder = store.history("v").folder
    tracker, group = spark.sparkContext.statusTracker(), "listing"
    spark.sparkContext.setJobGroup(group, group)
    assert folder.seen().visible == {"1"}
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")


def test_retention_rewrites_only_what_holds_both_kinds(spark, tmp_path):
    log = LogTable(spark, str(tmp_path / "log"))
    for name, days in (("old", [1, 2]), ("both", [2, 9]), ("new", [9, 10])):
        log.append(spark.createDataFrame([(d,) for d in days], "day int"), name)
    log.expire(F.col("day") >= 5)
    assert sorted(r.day for r in log.read().collect()) == [9, 9, 10]
    seen = log.folder.seen()
    assert "new" in seen.visible and {"old", "both"} <= seen.hidden and len(seen.visible) == 2
    log.expire(F.col("day") >= 5)
    assert log.folder.seen().visible == seen.visible
    log.folder.release()
    assert sorted(r.day for r in log.read().collect()) == [9, 9, 10]
    assert spark.read.parquet(log.folder.folder("old")).count() == 0
    log.compact()
    assert len(log.folder.seen().visible) == 1 and log.read().count() == 3


def test_changes_of_a_table_without_batches(store):
    store.compact()
    store.state("v").replace(store.state("v").read())
    assert keys(store) == ([], [])


@pytest.mark.parametrize("offline", [True, False])
def test_a_replay_is_no_newer_than_its_first_run(spark, tmp_path, offline):
    """Two batches with one event time: the later one wins, also when the first is written again, be it
    before or after a compaction that freed its space."""
    store = FeatureStore(spark, str(tmp_path / "store"))
    store.register_entity(Entity("user", ("user_id",)))
    store.register_feature_view(FeatureView("v", "user", (Feature("a"),), offline=offline))
    for value, batch in ((1.0, "one"), (2.0, "two"), (1.0, "one")):
        put(spark, store, "u", value, batch)
    assert [r.a.value for r in store.state("v").read().collect()] == [2.0]
    if offline:
        store.history("v").compact()
        store.history("v").folder.release()
    store.state("v").compact()
    put(spark, store, "u", 1.0, "one")
    assert [r.a.value for r in store.state("v").read().collect()] == [2.0]
