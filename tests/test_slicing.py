import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.slicing import SkewPolicy, find_splits, join_answers, running_totals


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("limit", [1, 30, None])
@pytest.mark.parametrize("span", [3, 10**9])
def test_running_totals(spark, limit, strict, span):
    rng = random.Random(span)
    rows = [(i, rng.choice("aaab"), rng.randint(0, span), rng.randint(1, 9)) for i in range(150)]
    df = spark.createDataFrame(rows, "i long, g string, at long, x long")
    policy = SkewPolicy(detect=False) if limit is None else SkewPolicy(rows_per_slice=limit)
    got = running_totals(df, ["g"], "at", {"total": F.col("x")}, strict=strict, policy=policy)
    for r in got.collect():
        want = sum(
            x for _, g, at, x in rows if g == r.g and (at < r.at if strict else at <= r.at)
        )
        assert r.total == want
    assert got.count() == 150


def test_sampled_detection_finds_the_large_group_and_keeps_all_rows(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"),
        (F.col("id") * 1000).alias("at"),
    )
    policy = SkewPolicy(rows_per_slice=8_000)
    splits = find_splits(df, ["g"], "at", policy)
    assert [t.collect()[0]["g"] for _, t in splits.levels[:1]] == ["hot"]
    sizes = splits.assign(df).groupBy(*splits.keys).count()
    assert sizes.agg(F.max("count")).first()[0] <= 8_000
    assert sizes.agg(F.sum("count")).first()[0] == 60_000


def test_no_large_group_means_no_splits(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), F.col("id").alias("at"))
    assert not find_splits(df, ["g"], "at")


@pytest.mark.parametrize("limit", [2, 100])
def test_join_answers_keeps_every_request(spark, limit):
    requests = [("hot", i) for i in range(40)] + [("b", 40), (None, 41), ("x", 42)]
    df = spark.createDataFrame(requests, "k string, n long")
    answers = spark.createDataFrame([("hot", 1), ("b", 2), ("unused", 3)], "k string, v long")
    got = join_answers(df, answers, "k", SkewPolicy(rows_per_slice=limit)).collect()
    want = {"hot": 1, "b": 2}
    assert sorted((r.n, r.v) for r in got) == sorted(
        ((n, want.get(k)) for k, n in requests), key=lambda p: p[0]
    )


def test_a_large_group_leaves_its_task_even_if_input_is_partitioned_by_group(spark):
    df = spark.range(2000).select(F.lit("hot").alias("g"), F.col("id").alias("at")).repartition("g")
    got = running_totals(df, ["g"], "at", {"n": F.lit(1)}, policy=SkewPolicy(rows_per_slice=100))
    per_task = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 2000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(g" in plan and "_slice0" in plan
