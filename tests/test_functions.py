import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numerics import epoch_micros, round_even
from tidemark.functions.scoring import explode_contributions, score
from tidemark.functions.transforms import (
    FRAUD_RATIOS,
    MERCHANT_EXPOSURE,
    RATIO_CALC,
    PandasTransformation,
    TransformationRegistry,
)
from tidemark.functions.values import typed
from tidemark.operators import quality
from tidemark.operators.parity import same
from tidemark.sources import logs
from tidemark.sources.export import json_rows, read_csv, write_csv
from tidemark.specs import DataType, Feature, FeatureView


def test_rounding_equals_numpy(spark):
    values = np.random.default_rng(1).normal(size=20_000) * 100
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = df.select(round_even(F.col("x"), 4)).toPandas().iloc[:, 0]
    assert (got.to_numpy() == values.round(4)).all()


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_zoneless_time_does_not_depend_on_the_session_zone(spark, zone):
    texts = ["2024-03-10 02:30:00.123456", "1969-12-31 23:59:59.999999", "2024-11-03 01:30:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        df = df.select(F.col("t").cast("timestamp_ntz").alias("t"))
        got = [r[0] for r in df.select(epoch_micros(F.col("t"), T.TimestampNTZType())).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [int(pd.Timestamp(t).value // 1000) for t in texts]


def test_fraud_ratios(spark):
    df = spark.createDataFrame(
        [(3, 7, 0.33, 0.5), (None, None, None, None), (2, 0, 0.0, 1.0)],
        "tx_count_10m long, tx_count_1h long, risk_score double, device_trust_score double",
    )
    got = [tuple(r)[-2:] for r in FRAUD_RATIOS.apply(df).collect()]
    assert got == [(0.4286, 0.2475), (0.0, 0.055), (2.0, 0.0)]


def test_missing_inputs_take_defaults_and_other_columns_stay(spark):
    row = MERCHANT_EXPOSURE.apply(spark.createDataFrame([("m", 2500.0)], "entity_key string, volume_30d double")).first()
    assert (row.entity_key, row.exposure_score) == ("m", 0.005)


def test_pandas_path_equals_columns(spark):
    df = spark.range(500).select("id", (F.col("id") / 7).alias("val_a"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).cast("double").alias("val_b"))
    made = PandasTransformation(
        "p", ("val_a", "val_b"), T.StructType([T.StructField("ratio", T.DoubleType())]),
        lambda b: pd.DataFrame({"ratio": (b.val_a.fillna(1.0) / np.maximum(b.val_b.fillna(1.0), 0.001)).round(4).to_numpy()}),
    )
    assert sorted(map(tuple, made.apply(df).collect())) == sorted(map(tuple, RATIO_CALC.apply(df).collect()))
    large = df.withColumn("id", F.when(F.col("id") > 0, F.col("id") + 9007199254740992))
    assert sorted(map(str, made.apply(large).select("id").collect())) == sorted(map(str, large.select("id").collect()))


def test_transformations_stay_in_the_engine(spark):
    df = spark.range(5).select(F.col("id").alias("val_a"), F.col("id").alias("val_b"))
    plan = RATIO_CALC.apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    known = TransformationRegistry()
    known.register(RATIO_CALC)
    assert known.get("ratio_calc") is RATIO_CALC
    with pytest.raises(ValueError):
        known.get("nope")


def test_fraud_score(spark):
    schema = "composite_risk double, tx_count_10m long, tx_amount_1h double, device_trust_score double, is_vpn boolean"
    df = spark.createDataFrame([(0.9, 8, 400.0, 0.2, True), (0.0, 0, None, None, None), (0.6, 5, 300.0, 0.5, True)], schema)
    scored = score(df, "fraud_sentinel_v2", prefix="").collect()

    def expected(r, n, a, t, v):
        z = 2.8 * r + 0.12 * n + 0.0006 * a - 1.9 * t + (1.2 if v else -0.3) - 0.4
        return round(1 / (1 + math.exp(-z)), 4)

    assert [r.probability_score for r in scored] == [
        expected(0.9, 8, 400, 0.2, True), expected(0.15, 1, 50, 0.9, False), expected(0.6, 5, 300, 0.5, True)
    ]
    assert [r.decision for r in scored] == ["DECLINED", "APPROVED", "DECLINED"]
    parts = {c.feature: c for c in scored[0].contributions}
    assert (parts["composite_risk"].impact, parts["composite_risk"].direction) == ("+40.5%", "risk")
    assert (parts["tx_amount_1h"].shown, parts["tx_amount_1h"].impact) == ("$400.00", "+16.0%")
    assert (parts["is_vpn"].shown, parts["is_vpn"].impact) == ("True", "+25.0%")
    assert explode_contributions(score(df.withColumn("id", F.lit(1)), "fraud_sentinel_v2", prefix=""), ["id"]).count() == 15


def test_other_scores(spark):
    merchant = spark.createDataFrame([(0.04, 4.0, 1234567.891, True), (None, 0.0, None, None)], "chargeback_rate double, exposure_score double, volume_30d double, high_risk_country boolean")
    got = score(merchant, "merchant_underwriter_v1", prefix="").collect()
    assert [r.decision for r in got] == ["TIER_3_RESTRICTED", "TIER_1_PRIME"]
    assert {c.feature: c.shown for c in got[0].contributions}["volume_30d"] == "$1,234,567.89"
    churn = spark.createDataFrame([(0.5, 3, 10.0, 5.0), (0.3, 3, 10.0, 5.0), (0.1, 3, 10.0, 5.0)], "churn_probability double, total_orders_count long, total_spend_amount double, avg_basket_value double")
    got = score(churn, "churn_predictor_v3", prefix="").collect()
    assert [r.decision for r in got] == ["HIGH_CHURN_RISK", "MODERATE_ENGAGEMENT", "LOYAL_CUSTOMER"]
    with pytest.raises(ValueError):
        score(churn, "fraud_sentinel_v2", prefix="")


@pytest.mark.parametrize(
    "kind, left, right, pairs",
    [
        ("num", "double", "double", [(1.0, 1.000009, True), (1.0, 1.1, False), (None, None, True), (None, 1.0, False), (1.0, None, False)]),
        ("flag", "boolean", "double", [(True, 1.0, True), (False, 1.0, False), (True, 2.0, True), (None, None, True), (None, 0.0, False)]),
        ("text", "string", "string", [("x", "x", True), ("x", "y", False), (None, "y", False), (None, None, True)]),
    ],
)
def test_match_rules(spark, kind, left, right, pairs):
    types = {"double": DataType.FLOAT64, "boolean": DataType.BOOLEAN, "string": DataType.STRING}
    df = spark.createDataFrame(pairs, f"a {left}, b {right}, want boolean").select(
        "want", F.lit(kind).alias("kind"), typed("a", types[left]).alias("online"), typed("b", types[right]).alias("offline")
    )
    assert all(r.want == r.m for r in df.select("want", same(1e-5).alias("m")).collect())


def test_validation(spark):
    view = FeatureView("v", "u", (Feature("i", DataType.INT64, min_value=0, max_value=5, default_value=7), Feature("f", DataType.FLOAT64), Feature("s", DataType.STRING), Feature("b", DataType.BOOLEAN)))
    df = spark.createDataFrame([(0, 1, "x", True), (5, 2, None, None), (6, 3, "y", False), (None, None, "z", True)], "i long, f long, s string, b boolean")
    got = {r.feature: (r.checked, r.violations) for r in quality.validate_features(df, view).collect()}
    assert got == {"i": (3, 1), "f": (3, 0), "s": (3, 0), "b": (3, 0)}
    good, bad = quality.split_valid(df, view)
    assert (good.count(), bad.count()) == (3, 1)
    wrong = spark.createDataFrame([("1", "x", 1, 1), (None, None, None, None)], "i string, f string, s long, b long")
    got = {r.feature: r.violations for r in quality.validate_features(wrong, view).collect()}
    assert got == {"i": 1, "f": 1, "s": 1, "b": 1}
    assert [r.i for r in quality.with_defaults(df, view).orderBy("s").collect()][-1] == 7


def test_schema_rule_names_missing_columns(spark):
    from tidemark.operators.pit import ViewData

    view = FeatureView("v", "u", (Feature("a"),))
    df = spark.createDataFrame([("u",)], "entity_key string")
    row = quality.schema_rules([ViewData(view, df), ViewData(view, None)]).first()
    assert (row.passed, row.observed) == (False, "Missing: ['a', 'event_timestamp']")


def test_csv_and_json(spark, tmp_path):
    df = spark.sql("select 'a,\"b' as s, timestamp_ntz'2026-01-01 00:00:00.5' as t, double('NaN') as d, cast(null as long) as n")
    path = str(tmp_path / "csv")
    write_csv(df.drop("d"), path)
    assert read_csv(df.drop("d"), path).collect() == df.drop("d").collect()
    nested = spark.sql("select 1 as i, array(1.5f, null) as v, map('a', 1) as m, cast(null as array<float>) as e")
    write_csv(nested, path)
    assert read_csv(nested, path).collect() == nested.collect()
    assert json_rows(df).first().json == '{"s":"a,\\"b","t":"2026-01-01T00:00:00.500000","d":null,"n":null}'


def test_logs_keep_the_newest(spark, tmp_path):
    table = logs.LogTable(spark, str(tmp_path / "log"))
    assert table.read() is None
    for batch in range(3):
        table.append(spark.range(batch * 10, batch * 10 + 10).select(F.col("id").alias("at"), "id"))
    assert [r.at for r in logs.newest(table.read(), 3, "at", "id").collect()] == [29, 28, 27]
    table.compact(F.col("at") >= 25)
    assert sorted(r.at for r in table.read().collect()) == [25, 26, 27, 28, 29]
    table.append(spark.range(30, 31).select(F.col("id").alias("at"), "id"))
    assert table.read().count() == 6


def test_unasked_features_differ_from_null_ones(spark):
    df = spark.createDataFrame([("u", None, 1)], "entity_key string, `v:a` double, `v:b` long").withColumn("t", F.current_timestamp())
    log = logs.served_features(df, {"v:a": DataType.FLOAT64, "v:b": DataType.INT64}, inference_id=F.lit(1), at=F.col("t"), asked={"v:b": F.lit(False)})
    assert log.first().features == {"v:a": (None, None, None)}
