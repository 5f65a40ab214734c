"""The feature store: registered views over history and state tables in one folder."""

from __future__ import annotations

import datetime as dt
import json
import time
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.keys import with_entity_key
from tidemark.functions.numerics import micros_of, moment
from tidemark.functions.scoring import model, score
from tidemark.functions.transforms import (
    PandasTransformation,
    Transformation,
    TransformationRegistry,
)
from tidemark.operators import drift, latest, parity, pit, profile, quality
from tidemark.operators.grid import observation_grid
from tidemark.operators.slicing import SkewPolicy
from tidemark.session import written
from tidemark.sources import logs
from tidemark.sources.export import json_safe, write_csv
from tidemark.sources.batches import BatchFolder, next_batch
from tidemark.sources.grid import GridTable
from tidemark.sources.history import HistoryTable, count_by_view, normalise
from tidemark.sources.state import StateTable
from tidemark.specs import BATCH, CREATED_TIME, ENTITY_KEY, EVENT_TIME, Entity, FeatureView, Ref, Registry
from tidemark.streaming.ingest import start_ingest

# Fixed value: rows shown as a sample of a generated data set.
DATASET_SAMPLE = 15
MEASURED = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("found", T.LongType()),
        T.StructField("row_count", T.LongType()),
    ]
)


@dataclass(frozen=True)
class ParityReport:
    """Outcome of a parity check, as three lazy reports on one written table."""

    summary: DataFrame
    mismatches: DataFrame
    drift: DataFrame


@dataclass(frozen=True)
class Dataset:
    """A generated training set: all rows, a summary row and a short sample."""

    rows: DataFrame
    summary: DataFrame
    sample: DataFrame


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class FeatureStore:
    """Ingest, serve, rebuild and check features.

    ``path`` is a folder that all executors share. ``time_type`` is the type of event
    times in it: zoned (default) or zone-less.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        time_type: T.DataType | None = None,
        policy: SkewPolicy | None = None,
    ) -> None:
        self.spark = spark
        self.path = path
        self.time_type = time_type or T.TimestampType()
        self.policy = policy
        self.registry = Registry()
        self.transformations = TransformationRegistry()
        self.rules: dict[str, list[quality.Rule]] = {}
        self.inferences = logs.LogTable(spark, f"{path}/log/inferences")
        self.audit = logs.AuditLog(logs.LogTable(spark, f"{path}/log/audit"))

    # Registration

    def save_registry(self) -> None:
        """Keep the entities and views beside the tables, for ``open``. Transformations and rules are code
        and are registered anew in each session."""
        text = json.dumps(self.registry.to_dict(), sort_keys=True)
        row = self.spark.createDataFrame([(text,)], "definitions string").coalesce(1)
        row.write.mode("overwrite").parquet(self._registries.folder(next_batch()))

    @property
    def _registries(self) -> BatchFolder:
        return BatchFolder(self.spark, f"{self.path}/registry")

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> FeatureStore:
        """The store at ``path`` with the registry that was saved last; it is an error if none was."""
        store = cls(spark, path, **options)
        saved = sorted(store._registries.present())
        if not saved:
            raise ValueError(f"no registry was saved at {path!r}")
        row = spark.read.parquet(store._registries.folder(saved[-1])).first()
        store.registry = Registry.from_dict(json.loads(row.definitions))
        return store

    def register_entity(self, entity: Entity) -> Entity:
        return self.registry.register_entity(entity)

    def register_feature_view(self, view: FeatureView) -> FeatureView:
        if view.transformation_name is not None:
            self.transformations.get(view.transformation_name)
        return self.registry.register_feature_view(view)

    def register_transformation(self, made: Transformation | PandasTransformation) -> None:
        self.transformations.register(made)

    def register_rules(self, view_name: str, rules: list[quality.Rule] | None = None) -> None:
        """Rules that every batch of a view is measured by while it is written; by default the declared
        bounds. Their measures must be counts, which add up over batches."""
        view = self.registry.view(view_name)
        if not view.offline:
            raise ValueError(f"view {view_name!r} keeps no history")
        rules = quality.bound_rules(view) if rules is None else list(rules)
        known = set(view.schema(self.time_type).names)
        unknown = sorted({c for r in rules for c in r.columns} - known)
        if unknown:
            raise ValueError(f"view {view_name!r} does not declare {unknown}")
        self.rules[view_name] = rules

    # Tables

    def measured(self, view_name: str) -> BatchFolder:
        """What the rules of a view found in its batches, a row a rule and batch."""
        return BatchFolder(self.spark, f"{self.path}/measured/{view_name}")

    def history(self, view_name: str) -> HistoryTable:
        view = self.registry.view(view_name)
        return HistoryTable(self.spark, f"{self.path}/history/{view_name}", view, self.time_type)

    def grid(self, view_name: str) -> GridTable:
        """The history laid out by key and month, once ``grid(...).refresh(history(...))`` has run."""
        view = self.registry.view(view_name)
        return GridTable(self.spark, f"{self.path}/grid/{view_name}", view, self.time_type)

    def state(self, view_name: str) -> StateTable:
        view = self.registry.view(view_name)
        return StateTable(self.spark, f"{self.path}/state/{view_name}", view, self.time_type)

    def _histories(self, names: list[str] | None = None) -> dict[str, pit.ViewData]:
        chosen = names if names is not None else list(self.registry.views)
        return {
            n: pit.ViewData(self.registry.view(n), self.history(n).read())
            for n in dict.fromkeys(chosen)
        }

    def _states(self, names: list[str] | None = None) -> dict[str, latest.ViewState]:
        chosen = names if names is not None else list(self.registry.views)
        return {
            n: latest.ViewState(self.registry.view(n), self.state(n).read())
            for n in dict.fromkeys(chosen)
        }

    # Ingestion

    def transform(self, view_name: str, df: DataFrame) -> DataFrame:
        name = self.registry.view(view_name).transformation_name
        return df if name is None else self.transformations.get(name).apply(df)

    def ingest_batch(
        self,
        view_name: str,
        df: DataFrame,
        *,
        sync_to_online: bool = True,
        batch: str | None = None,
    ) -> None:
        """Transform rows, append them to history, and update the latest state.

        The state is taken from the batch as it was written, so the input is computed once.
        """
        view = self.registry.view(view_name)
        again = batch is not None
        batch = batch or next_batch()
        rows = self.transform(view_name, with_entity_key(df, self.registry.entities[view.entity_name]))
        table = self.history(view_name)
        if view.offline:
            self._append(table, rows, batch)
            rows = table.read_batch(batch)
        else:
            # A replay keeps the created time of the first run, as it does in history.
            filled = again and CREATED_TIME not in rows.columns
            rows = normalise(rows, view, now=self.state(view_name).first_created(batch) if filled else None)
        if view.online and sync_to_online:
            self.state(view_name).upsert(latest.latest_values(rows, view), batch)

    def _append(self, table: HistoryTable, rows: DataFrame, batch: str) -> None:
        rules = self.rules.get(table.view.name)
        if not rules:
            table.append(rows, batch)
            return
        columns = table.view.schema(self.time_type).names
        found = table.append(rows, batch, measures=quality.measures(rules, columns))
        counts = [(r.rule_id, found[f"_m{i}"], found["_rows"]) for i, r in enumerate(rules)]
        kept = self.spark.createDataFrame(counts, MEASURED).coalesce(1)
        # A replay of the batch replaces what was found in it.
        kept.write.mode("overwrite").parquet(self.measured(table.view.name).folder(batch))

    def ingest_stream(
        self, view_name: str, stream: DataFrame, *, checkpoint: str, name: str, **trigger: Any
    ) -> StreamingQuery:
        """The same for a streaming DataFrame; see ``start_ingest``."""
        return start_ingest(
            self, view_name, stream, checkpoint=checkpoint, name=name, trigger=trigger or None
        )

    def backfill(self, view_names: list[str] | None = None) -> DataFrame:
        """Rebuild the state of views from the newest history row of every entity.

        What the state held before is gone, also of entities that history does not know; deltas that land
        meanwhile stay. Views that are not both online and offline are passed over. Reports rows, seconds
        and rows per second for each view.
        """
        report = []
        for name in view_names or list(self.registry.views):
            view = self.registry.view(name)
            if not (view.online and view.offline):
                continue
            begun = time.perf_counter()
            table = self.state(name)
            # Before history is listed: a delta that lands from now on is not in it for sure, and stays.
            deltas = table.deltas()
            newest = latest.latest_row(self.history(name).read(), view)
            table.replace(latest.state_of_rows(newest, view), deltas)
            rows = table.read().count()
            took = max(time.perf_counter() - begun, 0.001)
            report.append((name, rows, round(took * 1000.0, 2), round(rows / took, 1)))
        self.audit.record(
            "BACKFILL_SYNC", f"{sum(r[1] for r in report)} rows in {len(report)} views"
        )
        return self.spark.createDataFrame(
            report,
            "feature_view string, synced_records long, elapsed_ms double, rows_per_sec double",
        )

    def compact(self, view_names: list[str] | None = None) -> None:
        """Rewrite history and state of views, and the logs, as one batch each."""
        for name in view_names or list(self.registry.views):
            self.history(name).compact()
            self.state(name).compact()
        self.inferences.compact()
        self.audit.table.compact()

    def _written(self, df: DataFrame, purpose: str) -> DataFrame:
        return written(df, purpose, f"{self.path}/work/{purpose}-{next_batch()}")

    # Serving

    def get_online_features(
        self,
        requests: DataFrame,
        refs: list[str],
        *,
        now: dt.datetime | None = None,
        log_for_skew_check: bool = True,
    ) -> DataFrame:
        """Latest values for request rows with an ``entity_key`` column.

        Logged rows are computed once: they are written with an ``inference_id``, and what is
        returned and what is logged are both read from there.
        """
        self.registry.check_refs(refs)
        now = now or _utc_now()
        names = [Ref.parse(r).view for r in refs]
        served = latest.lookup(requests, self._states(names), refs, now, self.policy)
        if not log_for_skew_check:
            return served
        batch = next_batch()
        ident = F.concat(F.lit(f"{batch}-"), F.monotonically_increasing_id().cast("string"))
        served = written(
            served.withColumn("inference_id", ident), "served", f"{self.path}/served/{BATCH}={batch}"
        )
        dtypes = {Ref.parse(r).label: self.registry.feature(r).dtype for r in refs}
        at = moment(micros_of(now), self.time_type)
        self.inferences.append(
            logs.served_features(served, dtypes, inference_id=F.col("inference_id"), at=at), batch
        )
        return served

    def get_historical_features(
        self, entity_df: DataFrame, refs: list[str], *, as_known: bool = False
    ) -> DataFrame:
        """Features as of each row's ``event_timestamp``, with the views' TTLs.

        A spine without ``entity_key`` has the join keys of the views' entities, one or several. ``as_known``
        leaves out rows that were created after the observation.
        """
        self.registry.check_refs(refs)
        histories = self._histories([Ref.parse(r).view for r in refs])
        options = {"as_known": as_known, "policy": self.policy}
        if ENTITY_KEY not in entity_df.columns:
            return pit.join_entities(entity_df, histories, refs, self.registry.entities, **options)
        return pit.point_in_time_join(entity_df, histories, refs, **options)

    def get_timeline(self, entity_key: str, view_name: str) -> DataFrame:
        return self.history(view_name).timeline(entity_key)

    def time_travel(self, entity_key: str, view_name: str) -> DataFrame:
        """Each event of a timeline with what was known then and how much came later."""
        held = self._histories([view_name])
        events = held[view_name].data.where(F.col(ENTITY_KEY) == entity_key)
        refs = [f"{view_name}:{f}" for f in held[view_name].view.feature_names()]
        return pit.time_travel(
            events.select(ENTITY_KEY, EVENT_TIME), held, refs, policy=self.policy
        )

    def get_entity_all(self, entity_key: str) -> DataFrame:
        return latest.entity_all(self._states(), entity_key)

    def freshness(self, now: dt.datetime | None = None) -> DataFrame:
        return latest.freshness(self._states(), now or _utc_now())

    def freshness_report(self, limit: int, now: dt.datetime | None = None) -> DataFrame:
        """The ``limit`` stalest entities first; for all see ``freshness``."""
        return latest.stalest(self.freshness(now), limit)

    def predict(
        self, requests: DataFrame, model_id: str, *, now: dt.datetime | None = None
    ) -> DataFrame:
        """Latest features of each request, scored."""
        scored = score(
            self.get_online_features(requests, model(model_id).refs, now=now), model_id
        )
        self.audit.record("MODEL_INFERENCE", f"model {model_id} on a batch of requests")
        return scored

    def score_history(self, entity_df: DataFrame, model_id: str) -> DataFrame:
        """Features as of each row's time, scored."""
        return score(self.get_historical_features(entity_df, model(model_id).refs), model_id)

    def generate_dataset(
        self,
        entities: DataFrame,
        refs: list[str],
        observations_per_entity: int,
        *,
        now: dt.datetime | None = None,
        start: dt.datetime | None = None,
        end: dt.datetime | None = None,
        csv_path: str | None = None,
    ) -> Dataset:
        """A grid of observations with their features, on request also as CSV files."""
        grid = observation_grid(
            entities,
            observations_per_entity,
            now or _utc_now(),
            start=start,
            end=end,
            zoned=not isinstance(self.time_type, T.TimestampNTZType),
        )
        rows = self._written(self.get_historical_features(grid, refs), "dataset")
        if csv_path is not None:
            write_csv(rows, csv_path)
        summary = rows.agg(
            F.count("*").alias("total_records"), F.lit(len(refs)).alias("features_joined")
        )
        sample = json_safe(rows.orderBy(ENTITY_KEY, EVENT_TIME).limit(DATASET_SAMPLE))
        return Dataset(rows, summary, sample)

    # Checks

    def verify_skew(
        self,
        refs: list[str] | None = None,
        *,
        sample_size: int | None = None,
        since: dt.datetime | None = None,
        until: dt.datetime | None = None,
        float_tolerance: float = parity.TOLERANCE,
        use_ttl: bool = True,
    ) -> ParityReport:
        """Logged inferences against history; by default every registered feature and the whole log.

        ``since`` (inclusive) and ``until`` (exclusive) bound the time of the inferences.
        """
        refs = refs or [f"{v.name}:{f}" for v in self.registry.views.values() for f in v.feature_names()]
        self.registry.check_refs(refs)
        log = self.inferences.read()
        if log is None:
            log = self.spark.createDataFrame(
                [],
                "inference_id string, entity_key string, event_timestamp timestamp, features "
                "map<string, struct<num: double, text: string, flag: boolean>>",
            )
        if since is not None:
            log = log.where(F.col(EVENT_TIME) >= moment(micros_of(since), self.time_type))
        if until is not None:
            log = log.where(F.col(EVENT_TIME) < moment(micros_of(until), self.time_type))
        checks = parity.parity_checks(
            log,
            self._histories([Ref.parse(r).view for r in refs]),
            refs,
            sample_size=sample_size,
            tolerance=float_tolerance,
            use_ttl=use_ttl,
            policy=self.policy,
        )
        # Three reports read the checks; they are joined once and written.
        checks = self._written(checks, "parity")
        numeric = [r for r in refs if self.registry.feature(r).dtype.numeric]
        return ParityReport(
            parity.summary(checks),
            parity.mismatches(checks),
            drift.drift_report(
                parity.drift_values(checks),
                [Ref.parse(r).label for r in numeric],
                policy=self.policy,
            ),
        )

    def validate_quality(
        self,
        rules: dict[str, list[quality.Rule]],
        *,
        views: list[str] | None = None,
        parity_refs: list[str] | None = None,
        latencies: DataFrame | None = None,
    ) -> DataFrame:
        """Rule table: schema of the views, ``rules`` per view, parity and latency."""
        held = self._histories(views)
        stored = [pit.ViewData(self.registry.view(n), self.history(n).physical()) for n in held]
        parts = [quality.schema_rules(stored, self.spark)]
        for name, view_rules in rules.items():
            if name in held:
                parts.append(quality.check_table(held[name].data, view_rules))
        if parity_refs:
            checked = self.verify_skew(parity_refs).summary
            parts.append(quality.parity_rule(checked))
        if latencies is not None:
            parts.append(quality.latency_rule(profile.percentiles(latencies, "latency_ms")))
        checked = self._written(reduce(DataFrame.unionByName, parts), "quality")
        result = quality.quality_score(checked).first()
        self.audit.record(
            "QUALITY_VALIDATION",
            f"{result.passed_count}/{result.total_rules} rules passed "
            f"({result.quality_score_percent}%)",
        )
        return checked

    def batch_quality(self, view_name: str) -> DataFrame:
        """The rule rows of every batch of a view, from what was found while it was written."""
        return self._judged(view_name, BATCH)

    def ingested_quality(self, view_name: str) -> DataFrame:
        """The rule rows over all batches of a view, as a scan of its history would give them.

        A rule registered later than a batch has not seen that batch; ``validate_quality`` scans.
        """
        return self._judged(view_name)

    def _judged(self, view_name: str, *keys: str) -> DataFrame:
        rules = self.rules.get(view_name, [])
        if not rules:
            raise ValueError(f"view {view_name!r} has no rules")
        held = self.measured(view_name).read(MEASURED)
        if held is None:
            held = self.spark.createDataFrame([], T.StructType([*MEASURED.fields, T.StructField(BATCH, T.StringType())]))
        # One row a rule and batch comes in, one row a batch (or one at all) goes out.
        found = [
            F.coalesce(F.sum(F.when(F.col("rule_id") == r.rule_id, F.col("found"))), F.lit(0)).alias(f"_m{i}")
            for i, r in enumerate(rules)
        ]
        rows = F.sum(F.when(F.col("rule_id") == rules[0].rule_id, F.col("row_count")))
        summed = held.groupBy(*keys).agg(F.coalesce(rows, F.lit(0)).alias("_rows"), *found)
        columns = self.registry.view(view_name).schema(self.time_type).names
        return quality.judged(summed, rules, columns, *keys)

    def drift(self, refs: list[str] | None = None, **asked: Any) -> DataFrame:
        """Drift of served values against history, by default for all numeric features; takes the
        options of ``verify_skew``."""
        return self.verify_skew(refs or self.registry.numeric_refs(), **asked).drift

    def get_inference_logs(self, limit: int | None = None) -> DataFrame | None:
        """All logged inferences, or the newest ``limit``."""
        held = self.inferences.read()
        if held is None or limit is None:
            return held
        return logs.newest(held, limit, EVENT_TIME, "inference_id")

    def get_audit_logs(self, limit: int | None = None) -> DataFrame | None:
        return self.audit.read() if limit is None else self.audit.recent(limit)

    def totals(self) -> DataFrame:
        """One row: history rows, state keys and logged inferences over all views."""
        held = self.inferences.read()
        totals = self.get_telemetry().agg(
            F.sum("row_count").alias("total_rows"), F.sum("state_keys").alias("total_keys")
        )
        if held is None:
            return totals.withColumn("logged_inferences", F.lit(0).cast("long"))
        # One row on each side.
        counted = held.agg(F.count("*").alias("logged_inferences")).withColumn("one", F.lit(1))
        return totals.withColumn("one", F.lit(1)).join(counted, "one").drop("one")

    def get_telemetry(self) -> DataFrame:
        """Rows of history and keys of state per view."""
        rows = count_by_view({n: self.history(n).read() for n in self.registry.views})
        keys = reduce(
            DataFrame.unionByName,
            [
                held.data.agg(F.count("*").alias("state_keys")).select(
                    F.lit(n).alias("feature_view"), "state_keys"
                )
                for n, held in self._states().items()
            ],
        )
        return rows.join(keys, "feature_view")
