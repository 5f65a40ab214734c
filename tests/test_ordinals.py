"""Gapless row numbers without a window over the whole table."""

import pytest
from pyspark.sql import functions as F

from tidemark import Feature, FeatureView
from tidemark.operators.latest import ViewState
from tidemark.operators.ordinals import lookup_in_order, row_numbers
from times import T0


def numbers(df, name="row_no"):
    return sorted(r[name] for r in df.select(name).collect())


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_numbers_follow_the_order(spark, parts):
    rows = [((i * 37) % 500, None if i % 50 == 0 else f"t{i % 3}") for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b string").repartition(parts)
    got = row_numbers(df, "b", F.desc("a")).orderBy("row_no").collect()
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))
    assert [(r.a, r.b) for r in got] == want
    assert [r.row_no for r in got] == list(range(500))


def test_one_value_in_all_rows_is_dealt_over_partitions(spark, tmp_path):
    df = spark.range(20_000, numPartitions=6).select(F.lit(1).alias("a"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = row_numbers(df, "a", name="n", first=1, path=f"{tmp_path}/numbered")
        assert numbers(got, "n") == list(range(1, 20_001))
        files = spark.read.parquet(f"{tmp_path}/numbered").groupBy(F.input_file_name()).count().collect()
        assert len(files) > 4 and max(f["count"] for f in files) < 6_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_as_read_shuffle_nothing(spark):
    df = spark.range(1000, numPartitions=5)
    got = row_numbers(df)
    assert [(r.id, r.row_no) for r in got.orderBy("row_no").collect()] == [(i, i) for i in range(1000)]


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "a long, `x.y` string")
    assert row_numbers(df, "x.y").collect() == []
    with pytest.raises(ValueError, match="there already"):
        row_numbers(df, "a", name="a")


def test_repeated_rows_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "n"), (1, "n"), (None, None)], "a long, n string")
    got = row_numbers(df, "a").orderBy("row_no").collect()
    assert [tuple(r) for r in got] == [(None, None, 0), (1, "n", 1), (1, "n", 2)]


def test_answers_come_in_the_order_of_requests(spark):
    view = FeatureView("v", "user", (Feature("a"),))
    cell = "struct<value: double, ts: timestamp_ntz>"
    state = spark.createDataFrame([("x", (1.0, T0)), ("y", (2.0, T0))], f"entity_key string, a {cell}")
    asked = ["y", "x", None, "z", "y", "x"] * 50
    requests = spark.createDataFrame([(k,) for k in asked], "entity_key string").coalesce(1)
    got = lookup_in_order(requests, {"v": ViewState(view, state)}, ["v:a"], T0).collect()
    assert [(r.row_no, r.entity_key, r["v:a"]) for r in got] == [
        (i, k, {"x": 1.0, "y": 2.0}.get(k)) for i, k in enumerate(asked)
    ]
