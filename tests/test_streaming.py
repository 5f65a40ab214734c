import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Entity, FeatureStore
from tidemark.functions.transforms import FRAUD_RATIOS
from tidemark.operators.latest import latest_values
from tidemark.plans import views as V
from tidemark.sources.state import StateTable
from tidemark.streaming.ingest import stream_status, stream_totals
from tidemark.streaming.latest import start_latest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def feed(spark, tmp_path):
    events = V.table(spark, SF, "events")
    path = str(tmp_path / "feed")
    events.repartition(4, "event_id").write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return events, stream


def text(df):
    return sorted(map(str, df.collect()))


def test_stream_equals_batch_and_restarts(spark, feed, tmp_path):
    events, stream = feed
    stores = []
    for name in ("batch", "stream"):
        store = FeatureStore(spark, str(tmp_path / name), time_type=T.TimestampNTZType())
        store.register_entity(Entity("user", ("user_id",)))
        store.register_transformation(FRAUD_RATIOS)
        store.register_feature_view(V.USER_FRAUD)
        stores.append(store)
    batch, streamed = stores

    def payload(df):
        return df.select(
            F.col("user_id").alias("entity_key"),
            F.col("ts").alias("event_timestamp"),
            F.col("ts").alias("created_timestamp"),
            (F.col("event_id") % 5).alias("tx_count_10m"),
            (F.col("event_id") % 9).alias("tx_count_1h"),
            F.when(F.col("event_id") % 3 != 0, F.col("value") / 400).alias("risk_score"),
        )

    batch.ingest_batch("user_fraud_features", payload(events))
    for _ in range(2):
        query = streamed.ingest_stream(
            "user_fraud_features", payload(stream), checkpoint=str(tmp_path / "at"), name="pay"
        )
        query.awaitTermination()
    status = stream_status(query)
    assert status["active"] is False
    totals = stream_totals(streamed.history("user_fraud_features"), "pay").first()
    assert totals.total_streamed == streamed.history("user_fraud_features").count() > 0
    assert totals.last_batch == totals.batches - 1 and totals.start_time is not None
    for table in ("history", "state"):
        a = getattr(batch, table)("user_fraud_features").read()
        b = getattr(streamed, table)("user_fraud_features").read()
        assert text(a) == text(b) and a.count() > 0
    with pytest.raises(ValueError):
        streamed.ingest_stream("unknown", payload(stream), checkpoint=str(tmp_path / "x"), name="x")


def test_streaming_state_equals_batch_state(spark, feed, tmp_path):
    events, stream = feed
    view = V.EVENT_VIEWS["ev_view"]
    state = StateTable(spark, str(tmp_path / "state"), view, V.NAIVE)
    query = start_latest(state, V.sparse_history(stream), checkpoint=str(tmp_path / "at"), name="l")
    query.awaitTermination()
    status = stream_status(query)
    assert status["last_batch"] >= 3
    batch = StateTable(spark, str(tmp_path / "batch"), view, V.NAIVE)
    batch.upsert(latest_values(V.sparse_history(events), view))
    assert text(state.read()) == text(batch.read())
