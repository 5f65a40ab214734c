"""Repeated events, state that expires, sketches, and bounds of every type."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.latest import alive, latest_values
from tidemark.operators.quality import split_valid
from tidemark.operators.sketches import between, key_overlap, key_sketches, rank_error, sketched_quantiles, slots_for, value_sketches
from tidemark.plans import views as V
from tidemark.functions.numerics import epoch_micros
from tidemark.sources.state import StateTable
from tidemark.specs import DataType, Feature, FeatureView
from tidemark.streaming.expiry import SLICES, expiring_stream, start_expiring
from tidemark.streaming.once import missed, once
from times import T0, minutes

EVENT = "event_id long, entity_key string, event_timestamp timestamp_ntz, value double, k long"


def run(spark, rows_of_batches, schema, tmp_path, start):
    """Let batches arrive one by one, with a restart of the stream after each; the last query."""
    path = str(tmp_path / "feed")
    for rows in rows_of_batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        query = start(spark.readStream.schema(schema).parquet(path))
        query.awaitTermination()
    return query


def test_repeated_events_are_taken_once(spark, tmp_path):
    e = lambda i, at: (i, "a", minutes(at) if at is not None else None, 1.0, i)
    batches = [
        [e(1, 0), e(1, 0), e(2, 5), e(None, 3), e(None, 3), e(9, None), e(9, None)],
        [e(2, 5), e(3, 60), e(1, 0)],
        [e(3, 60), e(4, 1), e(5, 55)],
    ]
    out = str(tmp_path / "out")

    def start(stream):
        return (
            once(stream, ["event_id"], "10 minutes")
            .writeStream.option("checkpointLocation", str(tmp_path / "at"))
            .trigger(availableNow=True)
            .format("parquet")
            .start(out)
        )

    query = run(spark, batches, EVENT, tmp_path, start)
    got = spark.read.schema(EVENT).parquet(out)
    # 4 came 59 minutes behind. Events without an id or a time pass as they are.
    ids = sorted((r.event_id for r in got.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 5, 9, 9, None, None]
    everything = spark.createDataFrame([r for b in batches for r in b], EVENT)
    assert [r.event_id for r in missed(everything, got, ["event_id"]).collect()] == [4]
    assert query.exception() is None


VIEW = FeatureView("f", "user", (Feature("value"), Feature("k", DataType.INT64)), ttl_seconds=600)


def test_expired_state_is_forgotten_and_reads_the_same(spark, tmp_path):
    big = 2**62 + 1
    batches = [
        [(i, f"u{i}", minutes(0), float(i), big + i) for i in range(50)] + [(99, None, T0, 1.0, 1), (98, "x", None, 1.0, 1)],
        [(100, "u1", minutes(8), None, 7), (101, "u2", minutes(7), 5.0, None), (102, "u3", minutes(-1), 9.0, 9)],
        [(103, "u4", minutes(15), 4.5, big), (104, "u5", minutes(1), 3.0, 3)],
        [(105, "u4", minutes(16), None, None)],
    ]
    state = StateTable(spark, str(tmp_path / "state"), VIEW, V.NAIVE)
    query = run(
        spark,
        batches,
        EVENT,
        tmp_path,
        lambda s: start_expiring(state, s, checkpoint=str(tmp_path / "at"), name="t"),
    )
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Of 50 users, u1, u2 and u4 have an event within the last ten minutes.
    assert kept and kept[-1] == 3
    whole = spark.createDataFrame([r for b in batches for r in b], EVENT)
    now = F.unix_micros(F.lit(str(minutes(16))).cast("timestamp"))

    def served(cells):
        parts = [alive(F.col(c), 600, now, epoch_micros(F.col(f"{c}.ts"), V.NAIVE)).alias(c) for c in ("value", "k")]
        rows = cells.select("entity_key", *parts).where("value is not null or k is not null")
        return sorted(map(tuple, rows.collect()))

    assert served(state.read()) == served(latest_values(whole, VIEW))
    assert served(state.read()) == [("u1", None, 7), ("u2", 5.0, None), ("u4", 4.5, big)]


def test_expiring_state_is_spark_s_own_and_bounded(spark, tmp_path):
    batches = [
        [(i, f"u{i % 3}", minutes(i / 6), float(i) if i % 2 else None, i) for i in range(n, n + 180)]
        for n in (0, 180, 360)
    ]
    state, plans = StateTable(spark, str(tmp_path / "state"), VIEW, V.NAIVE), []

    def start(stream):
        plans.append(expiring_stream(stream, VIEW)._jdf.queryExecution().analyzed().toString())
        return start_expiring(state, stream, checkpoint=str(tmp_path / "at"), name="t")

    query = run(spark, batches, EVENT, tmp_path, start)
    assert not any("Pandas" in plan for plan in plans)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # Of an hour and a half, the slices of one TTL, and those cut by its ends, for each of three users.
    assert kept and 3 * SLICES <= kept[-1] <= 3 * (SLICES + 2)
    whole = spark.createDataFrame([r for b in batches for r in b], EVENT)
    merged = state.read().select("entity_key", "value", "k")
    want = latest_values(whole, VIEW).select("entity_key", "value", "k")
    values = lambda x: sorted((r[0], r[1].value, r[1].ts, r[2].value, r[2].ts) for r in x.collect())
    assert values(merged) == values(want)


def test_expiry_needs_a_ttl(spark):
    empty = spark.createDataFrame([], EVENT)
    with pytest.raises(ValueError):
        expiring_stream(empty, FeatureView("f", "user", (Feature("value"),)))


def test_quantiles_of_merged_days_keep_their_bound(spark):
    rows = spark.range(200_000).select(
        F.expr("timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id % 30 as int))").alias("event_timestamp"),
        F.expr("case when id % 10 = 0 then null when id % 10 = 1 then double('nan') else id end").alias("value"),
        (F.col("id") % 3).alias("few"),
    )
    daily = value_sketches(rows, ["value", "few"])
    assert daily.count() == 60 - 6  # days 0, 10, 20 and 1, 11, 21 have no value
    for days, keep in ((between(daily), lambda i: True), (between(daily, "2026-01-03", "2026-01-09"), lambda i: 2 <= i % 30 <= 8)):
        kept = [i for i in range(200_000) if keep(i)]
        values = [i for i in kept if i % 10 > 1]
        got = sketched_quantiles(days, [0.0, 0.25, 0.5, 0.99, 1.0]).where("feature = 'value'").collect()
        assert len(got) == 5
        for r in got:
            assert r.n == len(values)
            assert abs(sum(v <= r.value for v in values) / len(values) - r.share) <= 2 * rank_error()
    few = {r.share: r.value for r in sketched_quantiles(daily, [0.1, 0.5, 0.9]).where("feature = 'few'").collect()}
    assert few == {0.1: 0.0, 0.5: 1.0, 0.9: 2.0}


def test_key_sketches_count_and_intersect(spark):
    def rows(first, last):
        return spark.range(first, last).selectExpr(
            "cast(id as string) as entity_key", "timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id % 9 as int)) as event_timestamp"
        )

    small = key_overlap(key_sketches({"a": rows(0, 1000).union(rows(0, 300)), "b": rows(600, 2000)})).collect()
    assert [tuple(r) for r in small] == [("a", "b", 1000, 1400, 400, 2000)]
    large = key_overlap(key_sketches({"a": rows(0, 100_000), "b": rows(50_000, 150_000)})).first()
    for got, want in ((large.keys_a, 100_000), (large.keys_both, 50_000), (large.keys_any, 150_000)):
        assert abs(got / want - 1) < 5 * 2**-6
    empty = spark.createDataFrame([], EVENT)
    assert key_overlap(key_sketches({"a": empty, "b": empty})).collect() == []
    assert sketched_quantiles(value_sketches(empty, ["value"]), [0.5]).collect() == []


def test_key_counts_are_exact_with_slots_enough(spark):
    def rows(first, last):
        return spark.range(first, last).selectExpr(
            "cast(id as string) as entity_key", "timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, cast(id % 9 as int)) as event_timestamp"
        )

    held = {"a": rows(0, 100_000), "b": rows(50_000, 150_000), "c": rows(149_999, 150_001)}
    slots = slots_for(held)
    assert 100 < slots < 200
    got = sorted(map(tuple, key_overlap(key_sketches(held, slots=slots)).collect()))
    assert got == [
        ("a", "b", 100_000, 100_000, 50_000, 150_000),
        ("a", "c", 100_000, 2, 0, 100_002),
        ("b", "c", 100_000, 2, 1, 100_001),
    ]
    empty = {"a": spark.createDataFrame([], EVENT)}
    assert slots_for(empty) == 1


def test_bounds_of_every_type(spark):
    view = FeatureView(
        "v", "u", (Feature("s", DataType.STRING, min_value="b", max_value="d"), Feature("t", DataType.BOOLEAN, min_value=1))
    )
    rows = [("a", True), ("b", True), ("d", None), ("da", True), ("c", False), (None, True)]
    good, bad = split_valid(spark.createDataFrame(rows, "s string, t boolean"), view)
    assert sorted(map(tuple, good.collect()), key=str) == sorted([rows[1], rows[2], rows[5]], key=str)
    assert sorted(map(tuple, bad.collect()), key=str) == sorted([rows[0], rows[3], rows[4]], key=str)
    for feature in (Feature("s", DataType.STRING, min_value=1.0), Feature("t", DataType.BOOLEAN, max_value="x")):
        with pytest.raises(ValueError):
            split_valid(spark.createDataFrame(rows, "s string, t boolean"), FeatureView("v", "u", (feature,)))
