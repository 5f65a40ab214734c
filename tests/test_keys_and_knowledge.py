"""Observations that see only what had arrived, and keys of several columns and entities."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from times import T0, minutes

from tidemark import DataType, Entity, Feature, FeatureStore, FeatureView
from tidemark.functions.keys import entity_key, with_entity_key
from tidemark.operators.pit import ViewData, join_entities, point_in_time_join
from tidemark.operators.slicing import SkewPolicy

VIEW = FeatureView("v", "user", (Feature("a"), Feature("b", DataType.STRING)), ttl_seconds=3600, tie="no")
ROWS = "entity_key string, event_timestamp timestamp_ntz, created_timestamp timestamp_ntz, no long, a double, b string"


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = rng.randrange(200)
        rows.append((rng.choice("xyz" + "x" * 5), minutes(at), minutes(at + rng.choice([0, 0, 5, 40, 90])), i, rng.choice([None, float(i)]), f"b{i}"))
    spine = [(rng.choice("xyzw"), minutes(rng.randrange(260)), i) for i in range(150)]
    return rows, spine


def plain(rows, spine):
    out = {}
    for key, at, i in spine:
        seen = [r for r in rows if r[0] == key and r[1] <= at and r[2] <= at]
        best = max(seen, key=lambda r: (r[1], r[2], r[3]), default=None)
        fresh = best is not None and (at - best[1]).total_seconds() <= 3600
        out[i] = (best[4], best[5]) if fresh else (None, None)
    return out


@pytest.mark.parametrize("policy", [None, SkewPolicy(rows_per_slice=10)])
@pytest.mark.parametrize("seed", range(2))
def test_only_what_had_arrived_is_seen(spark, seed, policy):
    rows, spine = made(seed)
    held = {"v": ViewData(VIEW, spark.createDataFrame(rows, ROWS))}
    frame = spark.createDataFrame(spine, "entity_key string, event_timestamp timestamp_ntz, i long")
    joined = point_in_time_join(frame, held, ["v:a", "v:b"], as_known=True, policy=policy)
    assert {r.i: (r["v:a"], r["v:b"]) for r in joined.collect()} == plain(rows, spine)


def test_a_late_row_does_not_leak(spark):
    rows = [("x", T0, T0, 1, 1.0, "old"), ("x", minutes(5), minutes(30), 2, 2.0, "late")]
    held = {"v": ViewData(VIEW, spark.createDataFrame(rows, ROWS))}
    spine = spark.createDataFrame([("x", minutes(10)), ("x", minutes(30))], "entity_key string, event_timestamp timestamp_ntz")
    of = lambda **o: sorted((r.event_timestamp, r["v:b"]) for r in point_in_time_join(spine, held, ["v:b"], **o).collect())
    assert of(as_known=True) == [(minutes(10), "old"), (minutes(30), "late")]
    assert of() == [(minutes(10), "late"), (minutes(30), "late")]


def test_keys_of_several_columns_do_not_collide(spark):
    parts = ["", "1", "1:", "11", ":", "2:a", "a"]
    pairs = list(itertools.product(parts, parts))
    frame = spark.createDataFrame(pairs, "p string, q string").select(entity_key(("p", "q")).alias("k"))
    assert frame.distinct().count() == len(pairs)
    null = spark.createDataFrame([(None, "a")], "p string, q string").select(entity_key(("p", "q")).alias("k"))
    assert null.first().k is None
    with pytest.raises(ValueError):
        with_entity_key(frame, Entity("e", ("p", "q")))


def test_features_of_several_entities(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    for name, keys in (("user", ("u",)), ("shop", ("s",)), ("pair", ("u", "s"))):
        store.register_entity(Entity(name, keys))
        store.register_feature_view(FeatureView(f"{name}_v", name, (Feature("a"),)))
    utc = lambda m: F.lit(minutes(m).isoformat()).cast("timestamp")
    # The same text is a key of two entities.
    rows = spark.createDataFrame([("k", "k", 1.0), ("k", "z", 2.0), (None, "z", 3.0)], "u string, s string, a double")
    for i, name in enumerate(("user", "shop", "pair")):
        store.ingest_batch(f"{name}_v", rows.withColumns({"event_timestamp": utc(i), "a": F.col("a") + 10 * i}).where("a % 10 <> 2" if name == "user" else "true"))
    spine = spark.createDataFrame([(1, "k", "k"), (2, "k", "z"), (3, None, "z"), (4, "q", None), (1, "k", "k")], "i long, u string, s string")
    refs = ["user_v:a", "shop_v:a", "pair_v:a"]
    found = store.get_historical_features(spine.withColumn("event_timestamp", utc(60)), refs)
    got = sorted(((r.i, r["user_v:a"], r["shop_v:a"] in (12.0, 13.0) or r["shop_v:a"], r["pair_v:a"]) for r in found.collect()), key=str)
    assert got == sorted([(1, 1.0, 11.0, 21.0), (1, 1.0, 11.0, 21.0), (2, 1.0, True, 22.0), (3, None, True, None), (4, None, None, None)], key=str)
    assert found.columns == ["i", "u", "s", "event_timestamp", *refs]
    with pytest.raises(ValueError):
        join_entities(spine, store._histories(), refs, {})
