"""Rules measured in the pass that writes a batch."""

import pytest
from pyspark.sql import functions as F
from times import minutes

from tidemark import DataType, Entity, Feature, FeatureStore, FeatureView
from tidemark.operators import quality
from tidemark.streaming.ingest import start_ingest

VIEW = FeatureView(
    "v",
    "user",
    (
        Feature("a", min_value=0.0, max_value=1.0),
        Feature("b", DataType.STRING, min_value="c"),
        Feature("flag", DataType.BOOLEAN),
    ),
)
ROWS = "entity_key string, event_timestamp timestamp_ntz, a double, b string"


def filled(spark, tmp_path, rules=None):
    store = FeatureStore(spark, f"{tmp_path}/store")
    store.register_entity(Entity("user", ("user_id",)))
    store.register_feature_view(VIEW)
    store.register_rules("v", rules)
    return store


def rows(n, shift=0):
    return [(f"u{i}", minutes(i), [None, -1.0, 0.0, 1.0, 2.0, float("nan")][i % 6], "bcd"[i % 3]) for i in range(shift, shift + n)]


def asked(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


COLUMNS = ("rule_id", "name", "category", "passed", "expected", "observed")


def test_measured_rules_equal_a_scan(spark, tmp_path):
    rules = [*quality.bound_rules(VIEW), quality.not_null("nulls_a", "no null", "a"), quality.not_null("nulls_flag", "no null", "flag")]
    store = filled(spark, tmp_path, rules)
    for i in range(3):
        store.ingest_batch("v", spark.createDataFrame(rows(30, 7 * i), ROWS), batch=f"b{i}")
    scan = asked(quality.check_table(store.history("v").read(), rules), *COLUMNS)
    assert asked(store.ingested_quality("v"), *COLUMNS) == scan
    assert ("bounds_a", False, "30 violating rows") in asked(store.ingested_quality("v"), "rule_id", "passed", "observed")
    for i in range(3):
        stored = store.history("v").read_batch(f"b{i}").withColumn("flag", F.lit(None).cast("boolean"))
        per = store.batch_quality("v").where(f"batch = 'b{i}'")
        assert asked(per, *COLUMNS) == asked(quality.check_table(stored, rules), *COLUMNS)
    store.compact()
    assert asked(store.ingested_quality("v"), *COLUMNS) == scan


def test_a_replay_counts_once(spark, tmp_path):
    store = filled(spark, tmp_path)
    for _ in range(2):
        store.ingest_batch("v", spark.createDataFrame(rows(12), ROWS), batch="same")
    assert asked(store.ingested_quality("v"), "rule_id", "observed") == [("bounds_a", "4 violating rows"), ("bounds_b", "4 violating rows")]


def test_an_empty_batch_and_a_store_without_batches(spark, tmp_path):
    store = filled(spark, tmp_path)
    assert asked(store.ingested_quality("v"), "rule_id", "passed") == [("bounds_a", True), ("bounds_b", True)]
    assert store.batch_quality("v").collect() == []
    store.ingest_batch("v", spark.createDataFrame([], ROWS), batch="none")
    assert asked(store.batch_quality("v"), "batch", "rule_id", "observed") == [
        ("none", "bounds_a", "0 violating rows"),
        ("none", "bounds_b", "0 violating rows"),
    ]


def test_rules_name_declared_columns(spark, tmp_path):
    store = filled(spark, tmp_path)
    with pytest.raises(ValueError, match="does not declare"):
        store.register_rules("v", [quality.not_null("x", "x", "other")])
    store.register_rules("v", [])
    with pytest.raises(ValueError, match="no rules"):
        store.ingested_quality("v")


def test_micro_batches_are_measured(spark, tmp_path):
    store = filled(spark, tmp_path)
    for i in range(3):
        spark.createDataFrame(rows(6, 6 * i), ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_ingest(store, "v", events, checkpoint=f"{tmp_path}/cp", name="s").awaitTermination()
    got = store.batch_quality("v").where("rule_id = 'bounds_b'")
    assert asked(got, "batch", "observed") == [(f"s-{i:020d}", "2 violating rows") for i in range(3)]


def test_the_batch_is_read_once(spark, tmp_path):
    """Each input row passes the measured expression once: the input counts its own rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows(60), ROWS).mapInArrow(count, ROWS)
    filled(spark, tmp_path).ingest_batch("v", df, sync_to_online=False)
    assert seen.value == 60
