"""A history laid out by key and month opens few files for one key or some days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import Feature, FeatureView
from tidemark.sources.grid import GridTable
from tidemark.sources.history import HistoryTable

NTZ = T.TimestampNTZType()
VIEW = FeatureView("v", "user", (Feature("a"),))


def tables(spark, tmp_path):
    return HistoryTable(spark, f"{tmp_path}/h", VIEW, NTZ), GridTable(spark, f"{tmp_path}/g", VIEW, NTZ)


def rows(spark, n=2000, users=40):
    """Four months; every third row is of one user."""
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("id") * 5000).cast("timestamp_ntz")
    user = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % users)
    return spark.range(n).select(
        F.concat(F.lit("u"), user.cast("string")).alias("entity_key"), at.alias("event_timestamp"), F.col("id").cast("double").alias("a")
    )


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def plain(df):
    return sorted((r.entity_key, r.event_timestamp, r.a) for r in df.collect())


@pytest.fixture
def laid(spark, tmp_path):
    history, grid = tables(spark, tmp_path)
    history.append(rows(spark), "1")
    grid.refresh(history, key_cells=8)
    return history, grid


def test_answers_equal_a_scan_and_open_few_files(laid):
    history, grid = laid
    everything = files_read(grid.read())
    months = len(set(r.event_timestamp.month for r in history.read().select("event_timestamp").collect()))
    assert months == 4 and everything >= 8 * months / 2
    for key in ("u0", "u7", "nobody", ""):
        assert plain(grid.read(key)) == plain(history.read().where(F.col("entity_key") == key))
        assert files_read(grid.read(key)) <= everything / 4
    assert grid.timeline("u7").collect() == history.timeline("u7").collect()
    since, until = dt.datetime(2026, 2, 10, 3), dt.datetime(2026, 2, 12)
    inside = history.read().where((F.col("event_timestamp") >= F.lit(since).cast("timestamp_ntz")) & (F.col("event_timestamp") < F.lit(until).cast("timestamp_ntz")))
    assert plain(grid.read(since=since, until=until)) == plain(inside) != []
    assert files_read(grid.read(since=since, until=until)) <= everything / 3
    assert files_read(grid.read("u7", since=since, until=until)) == 1


def test_refresh_replaces(spark, laid):
    history, grid = laid
    history.append(rows(spark, 100), "2")
    assert grid.read().count() == 2000
    grid.refresh(history)
    assert plain(grid.read()) == plain(history.read())
    grid.refresh(history, key_cells=3)
    assert plain(grid.read("u3")) == plain(history.read().where("entity_key = 'u3'"))


def test_nulls_empty_and_no_table(spark, tmp_path):
    history, grid = tables(spark, tmp_path)
    assert grid.read("x").collect() == []
    grid.refresh(history)
    assert grid.read().collect() == []
    odd = spark.createDataFrame([(None, dt.datetime(2026, 1, 1), 1.0), ("x", None, 2.0), ("x", dt.datetime(2026, 1, 1), None)], "entity_key string, event_timestamp timestamp_ntz, a double")
    history.append(odd, "1")
    grid.refresh(history, key_cells=4)
    assert grid.read().count() == 3 and grid.read("x").count() == 2
    assert [r.a for r in grid.read("x", since=dt.datetime(2025, 1, 1)).collect()] == [None]
    with pytest.raises(ValueError, match="positive"):
        grid.refresh(history, key_cells=0)
