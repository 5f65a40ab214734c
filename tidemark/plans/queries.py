"""The registered queries: every operator over the business tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.keys import with_entity_key
from tidemark.functions.numerics import MICROS, epoch_micros, micros_of, moment
from tidemark.functions.scoring import explode_contributions, model, score, with_actions
from tidemark.functions.values import field_of, field_type, json_field
from tidemark.functions.transforms import (
    FRAUD_RATIOS,
    MERCHANT_EXPOSURE,
    RATIO_CALC,
    PandasTransformation,
)
from tidemark.operators import drift, latest, ordinals, parity, pit, profile, quality, sketches
from tidemark.operators.grid import observation_grid
from tidemark.operators.latest import ViewState
from tidemark.operators.ordinals import row_numbers
from tidemark.operators.pit import ViewData, point_in_time_join
from tidemark.plans import views as V
from tidemark.plans.store import DATASET_SAMPLE, FeatureStore
from tidemark.session import work_dir, written
from tidemark.sources import logs
from tidemark.sources.export import json_rows, json_safe, read_csv, write_csv
from tidemark.sources.batches import next_batch
from tidemark.sources.grid import GridTable
from tidemark.sources.history import HistoryTable, count_by_view, timeline
from tidemark.sources.state import StateTable
from tidemark.specs import CREATED_TIME, ENTITY_KEY, EVENT_TIME, DataType, Entity, Feature, FeatureView
from tidemark.streaming.expiry import start_expiring
from tidemark.streaming.ingest import recent_events, stream_totals as totals_of_stream
from tidemark.streaming.latest import start_latest
from tidemark.streaming.once import missed, once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EVENT_REFS = ["ev_view:value", "ev_view:k", "ev_click:value", "ev_error:value"]
ONE_USER = "7"
GRID_OBSERVATIONS = 6
# How many rows the queries show that are short by nature, and inferences of a newest-first check.
TOP, STALEST, STREAM_EVENTS = 100, 20, 30
NEWEST_INFERENCES, SHOWN_MISMATCHES = 500, 50
BUCKETS = 8


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "events")


def _flat_state(state: DataFrame) -> DataFrame:
    """State cells as plain columns ``feature`` and ``feature_ts``."""
    cells = [c for c in state.columns if c != ENTITY_KEY]
    return state.select(
        ENTITY_KEY,
        *[F.col(f"{c}.value").alias(c) for c in cells],
        *[F.col(f"{c}.ts").alias(f"{c}_ts") for c in cells],
    )


# Point-in-time joins


@query
def pit_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return point_in_time_join(
        V.purchase_spine(events), V.event_views(events), EVENT_REFS[:2], use_ttl=False
    )


@query
def pit_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return point_in_time_join(V.purchase_spine(events), V.event_views(events), EVENT_REFS[:2])


@query
def pit_multi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return point_in_time_join(V.purchase_spine(events), V.event_views(events), EVENT_REFS)


@query
def pit_orders_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ViewData(V.ORDER_VALUE, V.order_history(V.table(spark, sf_dir, "orders")))
    return point_in_time_join(
        V.customer_spine(V.table(spark, sf_dir, "customer")),
        {"order_value": held},
        ["order_value:o_totalprice", "order_value:o_orderpriority"],
    )


@query
def pit_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    held = ViewData(V.EVENT_VIEWS["ev_view"], V.sparse_history(events))
    return point_in_time_join(
        V.purchase_spine(events), {"ev_view": held}, EVENT_REFS[:2], use_ttl=False, per_feature=True
    )


@query
def pit_row_level_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    held = ViewData(V.EVENT_VIEWS["ev_view"], V.sparse_history(events))
    return point_in_time_join(V.purchase_spine(events), {"ev_view": held}, EVENT_REFS[:2])


LATE = FeatureView("late_view", "user", (Feature("value"), Feature("k", DataType.INT64)), V.DAY_SECONDS, tie="event_id")


@query
def pit_as_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of which most arrive hours late; a purchase sees only what had arrived."""
    events = _events(spark, sf_dir)
    late = events.where("event_type = 'view'").select(
        F.col("user_id").cast("string").alias(ENTITY_KEY),
        F.col("ts").alias(EVENT_TIME),
        F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 7 * 3 as int), 0, 0)").alias(CREATED_TIME),
        "event_id",
        "value",
        V._k().alias("k"),
    )
    refs = ["late_view:value", "late_view:k"]
    return point_in_time_join(V.purchase_spine(events), {"late_view": ViewData(LATE, late)}, refs, as_known=True)


ITEM_VIEW = FeatureView("item_view", "item", (Feature("value"),), V.DAY_SECONDS, tie="event_id")
USER_ITEM_VIEW = FeatureView("user_item_view", "user_item", (Feature("value"),), tie="event_id")
KEYED = {
    "user": Entity("user", ("user_id",)),
    "item": Entity("item", ("k",)),
    "user_item": Entity("user_item", ("user_id", "k")),
}


def _keyed(events: DataFrame, kind: str, view: FeatureView) -> ViewData:
    rows = events.where(F.col("event_type") == kind).withColumn("k", V._k())
    keyed = with_entity_key(rows, KEYED[view.entity_name])
    return ViewData(view, keyed.select(ENTITY_KEY, F.col("ts").alias(EVENT_TIME), "event_id", "value"))


def _keyed_spine(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'purchase'").select("event_id", "user_id", V._k().alias("k"), F.col("ts").alias(EVENT_TIME))


@query
def pit_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view by the same user of the same item."""
    events = _events(spark, sf_dir)
    spine = with_entity_key(_keyed_spine(events), KEYED["user_item"])
    held = {"user_item_view": _keyed(events, "view", USER_ITEM_VIEW)}
    return point_in_time_join(spine, held, ["user_item_view:value"]).drop(ENTITY_KEY)


@query
def pit_multi_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the user, of the item and of both, for each purchase, in one join."""
    events = _events(spark, sf_dir)
    held = {
        "ev_click": V.event_views(events)["ev_click"],
        "item_view": _keyed(events, "view", ITEM_VIEW),
        "user_item_view": _keyed(events, "view", USER_ITEM_VIEW),
    }
    refs = ["ev_click:value", "item_view:value", "user_item_view:value"]
    return pit.join_entities(_keyed_spine(events), held, refs, KEYED)


@query
def entity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(V.event_history(_events(spark, sf_dir), "view"), ONE_USER)


@query
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    history = V.event_history(events, "view").select(ENTITY_KEY, EVENT_TIME)
    return pit.time_travel(history, V.event_views(events), EVENT_REFS)


# Latest state


@query
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest_row(V.order_history(V.table(spark, sf_dir, "orders")), V.ORDER_VALUE)


@query
def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = V.sparse_history(_events(spark, sf_dir))
    return _flat_state(latest.latest_values(history, V.EVENT_VIEWS["ev_view"]))


def _states(events: DataFrame) -> dict[str, ViewState]:
    return {
        name: ViewState(held.view, latest.latest_values(held.data, held.view))
        for name, held in V.event_views(events).items()
    }


@query
def online_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    requests = events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("request_no"), F.col("user_id").alias(ENTITY_KEY)
    )
    return latest.lookup(requests, _states(events), EVENT_REFS, V.AS_OF)


@query
def spine_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases numbered by time, then by id."""
    return row_numbers(V.purchase_spine(_events(spark, sf_dir)), EVENT_TIME, "event_id")


@query
def lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for signups in the order of their ids."""
    events = _events(spark, sf_dir)
    requests = events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("request_no"), F.col("user_id").alias(ENTITY_KEY)
    )
    return ordinals.lookup_in_order(requests, _states(events), EVENT_REFS, V.AS_OF, "request_no")


@query
def entity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.entity_all(_states(_events(spark, sf_dir)), ONE_USER)


@query
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.freshness(_states(_events(spark, sf_dir)), V.AS_OF)


@query
def freshness_stalest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.stalest(freshness(spark, sf_dir), STALEST)


# Ingestion


def _store(spark: SparkSession, purpose: str) -> FeatureStore:
    store = FeatureStore(spark, work_dir(spark, purpose), time_type=V.NAIVE)
    for entity in V.ENTITIES:
        store.register_entity(entity)
    for made in (FRAUD_RATIOS, MERCHANT_EXPOSURE):
        store.register_transformation(made)
    return store


def _halves(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """View history before mid-January without ``k``, and after it with ``k``."""
    history = V.event_history(events, "view")
    split = F.lit(V.DRIFT_SPLIT.isoformat(sep=" ")).cast("timestamp_ntz")
    return (
        history.where(F.col(EVENT_TIME) < split).drop("k"),
        history.where(F.col(EVENT_TIME) >= split),
    )


@query
def append_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = FeatureView("ev_view", "user", (Feature("value"),))
    history = HistoryTable(spark, work_dir(spark, "evolve"), view, V.NAIVE)
    for part in _halves(_events(spark, sf_dir)):
        history.append(part, now=V.AS_OF)
    return history.read(evolved=True)


GROWING = FeatureView("ev_view", "user", (Feature("value"),), extra="extra")


@query
def append_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undeclared columns of which one changes its type between batches, and one comes later."""
    history = HistoryTable(spark, work_dir(spark, "variant"), GROWING, V.NAIVE)
    events = _events(spark, sf_dir).where("event_type = 'view'")
    rows = events.select(F.col("user_id").alias(ENTITY_KEY), F.col("ts").alias(EVENT_TIME), "value", "event_id", "props")
    split = F.lit(V.DRIFT_SPLIT.isoformat(sep=" ")).cast("timestamp_ntz")
    number = F.col("event_id").alias("note")
    text = F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("note")
    own = (ENTITY_KEY, EVENT_TIME, "value")
    history.append(rows.where(F.col(EVENT_TIME) < split).select(*own, number), now=V.AS_OF)
    history.append(
        rows.where(F.col(EVENT_TIME) >= split).select(*own, text, (F.col("value") > 50).alias("high"), "props"), now=V.AS_OF
    )
    extra = F.col("extra")
    return history.read().select(
        ENTITY_KEY,
        EVENT_TIME,
        field_type(extra, "note").alias("note_type"),
        field_of(extra, "note", "string").alias("note"),
        field_of(extra, "note", "bigint").alias("note_number"),
        field_of(extra, "high", "boolean").alias("high"),
        json_field(field_of(extra, "props", "string"), "k", "bigint").alias("k"),
    )


@query
def ingest_batch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "ingest")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    for part in _halves(_events(spark, sf_dir)):
        store.ingest_batch("ev_view", part)
    return _flat_state(store.state("ev_view").read())


@query
def backfill_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "backfill")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    store.ingest_batch("ev_view", V.sparse_history(_events(spark, sf_dir)), sync_to_online=False)
    store.backfill()
    return _flat_state(store.state("ev_view").read())


@query
def backfill_over_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill where the state holds older values that the newest rows lack."""
    store = _store(spark, "backfill")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    store.ingest_batch("ev_view", V.sparse_history(_events(spark, sf_dir)))
    store.backfill()
    return _flat_state(store.state("ev_view").read())


@query
def state_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest orders, ingested in two batches of which the first has the newer rows, then compacted."""
    store = _store(spark, "ties")
    store.register_feature_view(V.ORDER_VALUE)
    orders = V.order_history(V.table(spark, sf_dir, "orders"))
    orders = orders.withColumn(CREATED_TIME, F.col(EVENT_TIME))
    newer = F.col("o_orderkey") % 2 == 0
    for part in (orders.where(newer), orders.where(~newer)):
        store.ingest_batch("order_value", part)
    store.compact()
    return _flat_state(store.state("order_value").read())


@query
def compacted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of two batches after compaction, one of them replayed."""
    store = _store(spark, "compact")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    parts = _halves(_events(spark, sf_dir))
    for i, part in enumerate(parts):
        store.ingest_batch("ev_view", part, batch=f"part-{i}")
    store.compact()
    store.ingest_batch("ev_view", parts[1], batch="part-1")
    return store.history("ev_view").read().select(ENTITY_KEY, EVENT_TIME, "value", "k")


def _filled_store(spark: SparkSession, sf_dir: str) -> FeatureStore:
    store = _store(spark, "metrics")
    for name, held in V.event_views(_events(spark, sf_dir)).items():
        store.register_feature_view(held.view)
        store.ingest_batch(name, held.data)
    return store


def _grid_table(spark: SparkSession, sf_dir: str) -> GridTable:
    store = _store(spark, "grid")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    for i, part in enumerate(_halves(_events(spark, sf_dir))):
        store.ingest_batch("ev_view", part, batch=f"part-{i}", sync_to_online=False)
    store.grid("ev_view").refresh(store.history("ev_view"), key_cells=BUCKETS)
    return store.grid("ev_view")


@query
def grid_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline of one key from a history laid out by key and month: one cell is read."""
    return _grid_table(spark, sf_dir).timeline(ONE_USER).select(ENTITY_KEY, EVENT_TIME, "value", "k")


@query
def grid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys from mid-January on, from the same layout."""
    since = _grid_table(spark, sf_dir).read(since=V.DRIFT_SPLIT)
    return since.select(ENTITY_KEY, EVENT_TIME, "value", "k")


@query
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled_store(spark, sf_dir).get_telemetry()


@query
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled_store(spark, sf_dir).totals()


@query
def store_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serve all signups from the stored state, then read the inference log back."""
    store = _filled_store(spark, sf_dir)
    requests = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    store.get_online_features(
        requests.select(F.col("user_id").alias(ENTITY_KEY)), EVENT_REFS, now=V.AS_OF
    )
    log = store.inferences.read()
    return log.select(
        ENTITY_KEY,
        EVENT_TIME,
        *[F.col("features")[r]["num"].alias(r) for r in EVENT_REFS],
    )


@query
def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups served by a store that knows its views only from what was saved."""
    saved = _filled_store(spark, sf_dir)
    saved.save_registry()
    store = FeatureStore.open(spark, saved.path, time_type=V.NAIVE)
    requests = _events(spark, sf_dir).where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("request_no"), F.col("user_id").alias(ENTITY_KEY)
    )
    return store.get_online_features(requests, EVENT_REFS, now=V.AS_OF, log_for_skew_check=False)


@query
def store_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to state, state to served rows and log, and the log against history."""
    store = _filled_store(spark, sf_dir)
    requests = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    store.get_online_features(
        requests.select(F.col("user_id").alias(ENTITY_KEY)), EVENT_REFS, now=V.AS_OF
    )
    return store.verify_skew(EVENT_REFS).summary


TYPED = FeatureView("ev_typed", "user", (Feature("label", DataType.STRING), Feature("high", DataType.BOOLEAN)))


@query
def parity_store_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered feature, numbers, texts and truths, served and checked against history."""
    store = _filled_store(spark, sf_dir)
    store.register_feature_view(TYPED)
    views = V.event_history(_events(spark, sf_dir), "view")
    typed = views.select(
        ENTITY_KEY,
        EVENT_TIME,
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("label"),
        (F.col("value") > 50).alias("high"),
    )
    store.ingest_batch("ev_typed", typed)
    refs = [f"{v.name}:{f}" for v in store.registry.views.values() for f in v.feature_names()]
    requests = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    store.get_online_features(requests.select(F.col("user_id").alias(ENTITY_KEY)), refs, now=V.AS_OF)
    return store.verify_skew().summary


@query
def store_parity_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every third user that reach history after serving: exactly their inferences differ.

    The rows have the time of the inferences and come last, so no other row is newer to them.
    """
    store = _store(spark, "late")
    held = V.event_views(_events(spark, sf_dir))["ev_view"]
    store.register_feature_view(held.view)
    store.ingest_batch("ev_view", held.data)
    signups = _events(spark, sf_dir).where(F.col("event_type") == "signup")
    store.get_online_features(signups.select(F.col("user_id").alias(ENTITY_KEY)), ["ev_view:value"], now=V.AS_OF)
    users = signups.where("user_id % 3 = 0").select("user_id").distinct()
    late = users.select(
        F.col("user_id").cast("string").alias(ENTITY_KEY),
        moment(micros_of(V.AS_OF), V.NAIVE).alias(EVENT_TIME),
        (F.lit(1e6) + F.col("user_id")).alias("value"),
    )
    store.ingest_batch("ev_view", late, sync_to_online=False)
    found = store.verify_skew(["ev_view:value"]).mismatches
    return found.select(ENTITY_KEY, "feature", "online_num", "offline_num")


@query
def quality_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema rules of a store: a whole table, one whose files lack a column, one never written."""
    store = _store(spark, "schemas")
    history = V.event_views(_events(spark, sf_dir))
    for held in history.values():
        store.register_feature_view(held.view)
    store.ingest_batch("ev_view", history["ev_view"].data)
    store.ingest_batch("ev_click", history["ev_click"].data.drop("k"))
    return store.validate_quality({}).select("rule_id", "passed", "expected")


@query
def store_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = V.purchase_spine(_events(spark, sf_dir))
    return _filled_store(spark, sf_dir).get_historical_features(spine, EVENT_REFS)


@query
def pit_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multi-view join on histories bucketed by key: only the spine is shuffled."""
    events, held = _events(spark, sf_dir), {}
    for name, source in V.event_views(events).items():
        table = HistoryTable(spark, work_dir(spark, name), source.view, V.NAIVE)
        table.append(source.data)
        bucketed = table.bucketed(f"bucketed_{name}", BUCKETS)
        held[name] = ViewData(source.view, bucketed)
    return point_in_time_join(V.purchase_spine(events), held, EVENT_REFS, buckets=BUCKETS)


# Transformations


@query
def transform_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FRAUD_RATIOS.apply(V.user_fraud(_events(spark, sf_dir)))


@query
def transform_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MERCHANT_EXPOSURE.apply(V.merchant_risk(V.table(spark, sf_dir, "lineitem")))


def _ratio_inputs(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.col("value").alias("val_a"), V._k().cast("double").alias("val_b")
    )


@query
def transform_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RATIO_CALC.apply(_ratio_inputs(_events(spark, sf_dir)))


def _pandas_ratio(batch: pd.DataFrame) -> pd.DataFrame:
    ratio = batch["val_a"].fillna(1.0) / np.maximum(batch["val_b"].fillna(1.0), 0.001)
    return pd.DataFrame({"ratio": ratio.round(4)})


@query
def transform_python_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = PandasTransformation(
        "ratio_pandas",
        ("val_a", "val_b"),
        T.StructType([T.StructField("ratio", T.DoubleType())]),
        _pandas_ratio,
    )
    return made.apply(_ratio_inputs(_events(spark, sf_dir)))


# Parity and drift


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log table of served features, with known differences to history.

    By event id: every 13th lacks the values, every 17th has nulls, every 10th is off by
    one, every 7th by less than the tolerance; the first rule that applies counts.
    """
    events = _events(spark, sf_dir)
    served = point_in_time_join(V.purchase_spine(events), V.event_views(events), EVENT_REFS)
    number = F.col("event_id")
    changed = [r for r in EVENT_REFS if r.endswith(":value")]
    served = served.withColumns(
        {
            ref: F.expr(
                f"""CASE WHEN event_id % 17 = 0 THEN NULL
                         WHEN event_id % 10 = 0 THEN `{ref}` + 1D
                         WHEN event_id % 7 = 0 THEN `{ref}` + 5e-6D ELSE `{ref}` END"""
            )
            for ref in changed
        }
    )
    table = logs.LogTable(spark, work_dir(spark, "inferences"))
    table.append(
        logs.served_features(
            served,
            {r: DataType.INT64 if r.endswith(":k") else DataType.FLOAT64 for r in EVENT_REFS},
            inference_id=number,
            at=F.col(EVENT_TIME),
            asked={r: number % 13 != 0 for r in changed},
        )
    )
    return table.read()


def _checks(spark: SparkSession, sf_dir: str, sample_size: int | None = None) -> DataFrame:
    log = inference_log(spark, sf_dir)
    views = V.event_views(_events(spark, sf_dir))
    return parity.parity_checks(log, views, EVENT_REFS, sample_size=sample_size)


@query
def parity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.summary(_checks(spark, sf_dir))


@query
def parity_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity.mismatches(_checks(spark, sf_dir), limit=None)
    return found.select(
        "inference_id", ENTITY_KEY, EVENT_TIME, "feature", "online_num", "offline_num"
    )


@query
def parity_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity.mismatches(_checks(spark, sf_dir, NEWEST_INFERENCES), SHOWN_MISMATCHES)
    return found.select(
        "inference_id", ENTITY_KEY, EVENT_TIME, "feature", "online_num", "offline_num"
    )


@query
def parity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = written(_checks(spark, sf_dir), "checks")
    return drift.drift_report(parity.drift_values(checks), EVENT_REFS)


@query
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.psi(V.drift_sides(_events(spark, sf_dir)), V.EVENT_TYPES)
    return found.select(
        "feature", F.round("psi", 9).alias("psi"), "baseline_count", "current_count"
    )


@query
def drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift_report(V.drift_sides(_events(spark, sf_dir)), V.EVENT_TYPES)


@query
def drift_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.overall_status(drift.drift_report(V.drift_sides(_events(spark, sf_dir)), V.EVENT_TYPES))


@query
def drift_every_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of every user's values: most users have too few of them, and the report says so."""
    events = _events(spark, sf_dir).where("user_id is not null")
    sides = V.drift_sides(events.withColumn("event_type", F.col("user_id").cast("string")))
    report = drift.drift_report(sides, sides.select("feature"))
    return report.select("feature", "status", "baseline_count", "current_count")


# Quality

# Ids, names and bounds of the rules.
FRAUD_RULES = [
    quality.not_null(
        "null_check_risk_score", "Null Rate Check (user_fraud_features:risk_score)", "risk_score"
    ),
    quality.in_range(
        "range_check_risk_score", "Value Range Bounds (0.0 <= risk_score <= 1.0)", "risk_score", 0.0, 1.0
    ),
    quality.in_range(
        "range_check_device_trust",
        "Value Range Bounds (0.0 <= device_trust_score <= 1.0)",
        "device_trust_score",
        0.0,
        1.0,
    ),
    quality.not_negative(
        "non_negative_tx_counts",
        "Non-Negative Counts (tx_count_10m, tx_count_1h >= 0)",
        "tx_count_10m",
        "tx_count_1h",
    ),
]
MERCHANT_RULES = [
    quality.in_range(
        "merchant_cb_rate_bounds",
        "Merchant Chargeback Rate Bounds (0.0 <= chargeback_rate <= 1.0)",
        "chargeback_rate",
        0.0,
        1.0,
    )
]


@query
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraud = FRAUD_RATIOS.apply(V.user_fraud(_events(spark, sf_dir)))
    merchant = V.merchant_risk(V.table(spark, sf_dir, "lineitem"))
    held = [ViewData(V.USER_FRAUD, fraud), ViewData(V.MERCHANT_RISK, merchant)]
    parts = [
        quality.schema_rules(held),
        quality.check_table(fraud, FRAUD_RULES),
        quality.check_table(merchant, MERCHANT_RULES),
        quality.parity_rule(parity_summary(spark, sf_dir)),
    ]
    return reduce(DataFrame.unionByName, parts)


def _measured_store(spark: SparkSession, sf_dir: str) -> FeatureStore:
    """Fraud features in two batches, each measured by the rules while it was written."""
    store = _store(spark, "measured")
    store.register_feature_view(V.USER_FRAUD)
    store.register_rules("user_fraud_features", FRAUD_RULES)
    fraud = V.user_fraud(_events(spark, sf_dir))
    split = F.lit(V.DRIFT_SPLIT.isoformat(sep=" ")).cast("timestamp_ntz")
    for name, part in (("early", F.col(EVENT_TIME) < split), ("late", F.col(EVENT_TIME) >= split)):
        store.ingest_batch("user_fraud_features", fraud.where(part), batch=name, sync_to_online=False)
    return store


@query
def quality_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured_store(spark, sf_dir).batch_quality("user_fraud_features").select("batch", "rule_id", "passed", "observed")


@query
def quality_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over all batches, added up from what was found in each."""
    return _measured_store(spark, sf_dir).ingested_quality("user_fraud_features")


@query
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_score(quality_rules(spark, sf_dir))


@query
def latency_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latency_rule(profile.percentiles(_events(spark, sf_dir), "value"))


@query
def validate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraud = FRAUD_RATIOS.apply(V.user_fraud(_events(spark, sf_dir)))
    vectors = V.vectors(V.table(spark, sf_dir, "embeddings"))
    return quality.validate_features(fraud, V.USER_FRAUD).unionByName(
        quality.validate_features(vectors, V.VECTORS)
    )


@query
def defaults_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = FeatureView(
        "risk", "user", (Feature("risk_score", default_value=0.1), Feature("is_vpn", DataType.BOOLEAN))
    )
    filled = quality.with_defaults(V.user_fraud(_events(spark, sf_dir)), view)
    return filled.select("event_id", "risk_score", "is_vpn")


@query
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = quality.split_valid(V.user_fraud(_events(spark, sf_dir)), V.USER_FRAUD)
    return good.select("event_id", ENTITY_KEY, EVENT_TIME, "risk_score")


@query
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = quality.rejects(V.user_fraud(_events(spark, sf_dir)), V.USER_FRAUD)
    return bad.select("event_id", ENTITY_KEY, "reason")


# Data sets


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = _events(spark, sf_dir).select(F.col("user_id").alias(ENTITY_KEY)).distinct()
    return observation_grid(entities, GRID_OBSERVATIONS, V.AS_OF, zoned=False)


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = V.event_views(_events(spark, sf_dir))
    return point_in_time_join(_grid(spark, sf_dir), views, EVENT_REFS)


@query
def dataset_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir)


@query
def dataset_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _dataset(spark, sf_dir), work_dir(spark, "csv")
    write_csv(rows, path)
    return read_csv(rows, path)


@query
def dataset_csv_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, written as CSV and read back, one row a component."""
    vectors = V.vectors(V.table(spark, sf_dir, "embeddings"))
    rows, path = vectors.select(ENTITY_KEY, "embedding"), work_dir(spark, "csv")
    write_csv(rows, path)
    parts = read_csv(rows, path).select(ENTITY_KEY, F.posexplode("embedding").alias("place", "value"))
    return parts.withColumn("value", F.col("value").cast("double"))


@query
def dataset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_rows(V.purchase_spine(_events(spark, sf_dir)), "json")


@query
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, sf_dir).agg(
        F.count("*").alias("total_records"), F.lit(len(EVENT_REFS)).alias("features_joined")
    )


@query
def dataset_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dataset(spark, sf_dir).orderBy(ENTITY_KEY, EVENT_TIME).limit(DATASET_SAMPLE)
    return json_safe(rows)


# Scores


def _score_columns(scored: DataFrame) -> DataFrame:
    return scored.select(ENTITY_KEY, EVENT_TIME, "probability_score", "decision")


@query
def score_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraud = FRAUD_RATIOS.apply(V.user_fraud(_events(spark, sf_dir)))
    return _score_columns(score(fraud, "fraud_sentinel_v2", prefix=""))


@query
def score_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every purchase with the features known just then."""
    events = _events(spark, sf_dir)
    history = FRAUD_RATIOS.apply(V.user_fraud(events.where(F.col("event_type") != "purchase")))
    held = ViewData(V.USER_FRAUD, written(history, "fraud"))
    chosen = model("fraud_sentinel_v2")
    joined = point_in_time_join(V.purchase_spine(events), {chosen.view: held}, chosen.refs)
    return score(joined, chosen.model_id).select(
        "event_id", ENTITY_KEY, EVENT_TIME, "probability_score", "decision"
    )


@query
def score_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every customer with the latest lifetime value."""
    clv = V.clv(V.table(spark, sf_dir, "orders"))
    states = {V.CLV.name: ViewState(V.CLV, latest.latest_values(clv, V.CLV))}
    requests = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(ENTITY_KEY))
    chosen = model("churn_predictor_v3")
    found = latest.lookup(requests, states, chosen.refs, V.ORDERS_AS_OF)
    return score(found, chosen.model_id).select(ENTITY_KEY, "probability_score", "decision")


@query
def score_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    merchant = MERCHANT_EXPOSURE.apply(V.merchant_risk(V.table(spark, sf_dir, "lineitem")))
    return _score_columns(score(merchant, "merchant_underwriter_v1", prefix=""))


@query
def score_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    clv = V.clv(V.table(spark, sf_dir, "orders"))
    return _score_columns(score(clv, "churn_predictor_v3", prefix=""))


@query
def score_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the three scorers recommends."""
    scored = {"fraud_sentinel_v2": score_fraud, "merchant_underwriter_v1": score_merchant, "churn_predictor_v3": score_churn}
    shown = ("entity_key", "event_timestamp", "decision_badge", "action_recommendation", "probability_percent")
    parts = [with_actions(s(spark, sf_dir)).select(F.lit(m).alias("model_id"), *shown) for m, s in scored.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraud = FRAUD_RATIOS.apply(V.user_fraud(_events(spark, sf_dir)))
    return explode_contributions(score(fraud, "fraud_sentinel_v2", prefix=""), ["event_id"])


@query
def score_contributions_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    merchant = MERCHANT_EXPOSURE.apply(V.merchant_risk(V.table(spark, sf_dir, "lineitem")))
    scored = score(merchant, "merchant_underwriter_v1", prefix="")
    return explode_contributions(scored, [ENTITY_KEY, EVENT_TIME])


@query
def score_contributions_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(V.clv(V.table(spark, sf_dir, "orders")), "churn_predictor_v3", prefix="")
    return explode_contributions(scored, [ENTITY_KEY])


# Summaries and logs


@query
def profile_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.percentiles(_events(spark, sf_dir), "value")


@query
def profile_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    at_us = epoch_micros(F.col("ts"), events.schema["ts"].dataType)
    return profile.basics(events, "value", at_us=at_us)


@query
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(_events(spark, sf_dir), "value")


@query
def count_by_view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders = _events(spark, sf_dir), V.table(spark, sf_dir, "orders")
    histories = {name: held.data for name, held in V.event_views(events).items()}
    return count_by_view({**histories, "order_value": V.order_history(orders)})


@query
def log_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    return logs.newest(log, TOP, "ts", "event_id")


# Streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, one file per micro-batch."""
    events, path = _events(spark, sf_dir), work_dir(spark, "feed")
    events.repartition(4, "event_id").write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(path)


@query
def stream_ingest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, "stream")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    feed = V.event_history(_event_stream(spark, sf_dir), "view")
    store.ingest_stream(
        "ev_view", feed, checkpoint=work_dir(spark, "stream-at"), name="views"
    ).awaitTermination()
    return store.history("ev_view").read().select(ENTITY_KEY, EVENT_TIME, "value", "k")


@query
def stream_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_events(stream_ingest_history(spark, sf_dir), STREAM_EVENTS)


@query
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream has written, from its stored batches."""
    store = _store(spark, "stream")
    store.register_feature_view(V.EVENT_VIEWS["ev_view"])
    feed = V.event_history(_event_stream(spark, sf_dir), "view")
    store.ingest_stream(
        "ev_view", feed, checkpoint=work_dir(spark, "stream-at"), name="views"
    ).awaitTermination()
    return totals_of_stream(store.history("ev_view"), "views").select("total_streamed")


@query
def stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchant exposure computed in a stream, read back from history."""
    store = _store(spark, "stream")
    store.register_feature_view(V.MERCHANT_RISK)
    path = work_dir(spark, "feed")
    merchant = V.merchant_risk(V.table(spark, sf_dir, "lineitem"))
    merchant.repartition(3, ENTITY_KEY).write.parquet(path)
    feed = spark.readStream.schema(merchant.schema).option("maxFilesPerTrigger", 1).parquet(path)
    store.ingest_stream(
        V.MERCHANT_RISK.name, feed, checkpoint=work_dir(spark, "stream-at"), name="merchants"
    ).awaitTermination()
    return store.history(V.MERCHANT_RISK.name).read().select(*merchant.columns, "exposure_score")


@query
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = StateTable(spark, work_dir(spark, "state"), V.EVENT_VIEWS["ev_view"], V.NAIVE)
    feed = V.sparse_history(_event_stream(spark, sf_dir))
    start_latest(
        state, feed, checkpoint=work_dir(spark, "state-at"), name="latest"
    ).awaitTermination()
    return _flat_state(state.read())


PARTS = 4


def _in_time_parts(events: DataFrame) -> tuple[DataFrame, int]:
    """Events with ``part``, the quarter of their time range, and the quarter's length in seconds."""
    at = epoch_micros(F.col("ts"), events.schema["ts"].dataType)
    first, last = events.agg(F.min(at), F.max(at)).first()
    length = ((last or 0) - (first or 0)) // PARTS + 1
    return events.withColumn("part", F.floor((at - (first or 0)) / length).cast("int")), max(length // MICROS, 1)


def _fed_in_parts(
    rows: DataFrame, path: str, start: Callable[[DataFrame], StreamingQuery]
) -> None:
    """Let the parts arrive one after the other, each followed by a restart of the stream."""
    arriving = rows.drop("part")
    for part in range(PARTS):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(path)
        start(rows.sparkSession.readStream.schema(arriving.schema).parquet(path)).awaitTermination()


@query
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of which a third come again with the next quarter, and some of the first quarter with the last:
    history takes each once, and the audit finds those beyond the declared delay of one and a half quarters."""
    views, seconds = _in_time_parts(_events(spark, sf_dir).where("event_type = 'view'"))
    held_back = "part = 0 AND event_id % 50 = 7"
    parts = f"""CASE WHEN {held_back} THEN array({PARTS - 1})
        WHEN event_id % 3 = 0 THEN array(part, least(part + 1, {PARTS - 1})) ELSE array(part) END"""
    arrivals = written(
        views.select(
            F.col("user_id").cast("string").alias(ENTITY_KEY),
            F.col("ts").alias(EVENT_TIME),
            F.col("ts").alias(CREATED_TIME),
            "event_id",
            "value",
            V._k().alias("k"),
            F.explode(F.expr(parts)).alias("part"),
        ),
        "arrivals",
    )
    store = _store(spark, "dedup")
    store.register_feature_view(LATE)
    at = work_dir(spark, "dedup-at")
    delay = f"{seconds + seconds // 2} seconds"
    _fed_in_parts(
        arrivals,
        work_dir(spark, "feed"),
        lambda stream: store.ingest_stream(
            LATE.name, once(stream, ["event_id"], delay), checkpoint=at, name="views"
        ),
    )
    columns = ["event_id", ENTITY_KEY, EVENT_TIME, "value", "k"]
    taken = store.history(LATE.name).read().select(*columns)
    late = missed(arrivals.select(*columns), taken, ["event_id"])
    return taken.withColumn("taken", F.lit(True)).union(late.withColumn("taken", F.lit(False)))


@query
def stream_ttl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is alive when the last event has come, from a stream that forgets what has expired."""
    view = V.EVENT_VIEWS["ev_view"]
    events, _ = _in_time_parts(_events(spark, sf_dir).where("event_type = 'view'"))
    state, at = StateTable(spark, work_dir(spark, "state"), view, V.NAIVE), work_dir(spark, "ttl-at")
    _fed_in_parts(
        written(events, "arrivals"),
        work_dir(spark, "feed"),
        lambda stream: start_expiring(state, V.sparse_history(stream), checkpoint=at, name="alive"),
    )
    now = events.agg(F.max(epoch_micros(F.col("ts"), V.NAIVE)).alias("now"))
    cells = [
        latest.alive(
            F.col(f.name), view.ttl_seconds, F.col("now"), epoch_micros(F.col(f"{f.name}.ts"), V.NAIVE)
        ).alias(f.name)
        for f in view.features
    ]
    alive = state.read().crossJoin(F.broadcast(now)).select(ENTITY_KEY, *cells)  # one row
    return alive.where(reduce(lambda a, b: a | b, [F.col(f.name).isNotNull() for f in view.features]))


SKETCHED = (0.1, 0.5, 0.9)


@query
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether merged daily sketches of value and k keep their rank error, judged by a scan."""
    events = _events(spark, sf_dir).select("ts", "value", V._k().alias("k"))
    daily = sketches.value_sketches(events, ["value", "k"], event_time="ts")
    found = written(sketches.sketched_quantiles(daily, SKETCHED), "quantiles")
    values = events.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in ("value", "k")]))
    ).where("x IS NOT NULL AND NOT isnan(x)")
    ranks = values.join(F.broadcast(found), "feature").groupBy("feature", "n", "share").agg(  # six rows
        (F.count_if(F.col("x") < F.col("value")) / F.col("n")).alias("below"),
        (F.count_if(F.col("x") <= F.col("value")) / F.col("n")).alias("upto"),
    )
    error = sketches.rank_error()
    fits = (F.col("below") <= F.col("share") + error) & (F.col("upto") >= F.col("share") - error)
    return ranks.select("feature", "n", "share", fits.alias("within_bound"))


@query
def sketch_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that each two views share, from daily sketches; exact, in as many slots as the users need."""
    held = {name: view.data for name, view in V.event_views(_events(spark, sf_dir)).items()}
    return sketches.key_overlap(sketches.key_sketches(held, slots=sketches.slots_for(held)))
