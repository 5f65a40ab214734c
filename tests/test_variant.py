"""Undeclared fields in one VARIANT column."""

import pytest
from pyspark.sql import functions as F
from times import T0

from tidemark import Feature, FeatureView
from tidemark.functions.values import field_of, field_type, json_field
from tidemark.sources.history import HistoryTable

VIEW = FeatureView("v", "user", (Feature("a"),), extra="extra")
KEYS = "entity_key string, event_timestamp timestamp, a double"


def table(spark, tmp_path):
    return HistoryTable(spark, f"{tmp_path}/h", VIEW)


def put(spark, held, more, values, batch):
    row = ("x", T0, 1.0, *values)
    held.append(spark.createDataFrame([row], f"{KEYS}{', ' if more else ''}{more}"), batch)


def test_a_type_that_changes_is_kept(spark, tmp_path):
    held = table(spark, tmp_path)
    put(spark, held, "n long, `x.y` string", (7, "t"), "1")
    put(spark, held, "n string", ("seven",), "2")
    put(spark, held, "n struct<m: double>", ((0.5,),), "3")
    put(spark, held, "n long", (None,), "4")
    put(spark, held, "", (), "5")
    n = F.col("extra")
    for _ in range(2):
        got = held.read().select(
            field_type(n, "n").alias("t"),
            field_of(n, "n", "string").alias("s"),
            field_of(n, "n", "long").alias("l"),
            field_of(n, "x.y", "string").alias("xy"),
        )
        assert sorted(map(tuple, got.collect()), key=str) == sorted(
            [
                ("BIGINT", "7", 7, "t"),
                ("STRING", "seven", None, None),
                ("OBJECT<m: DOUBLE>", '{"m":0.5}', None, None),
                ("VOID", None, None, None),
                (None, None, None, None),
            ],
            key=str,
        )
        held.compact()
    assert "extra" in held.read(evolved=True).columns and "n" not in held.read(evolved=True).columns


def test_the_column_itself_may_come(spark, tmp_path):
    held = table(spark, tmp_path)
    rows = spark.createDataFrame([("x", T0, 1.0, '{"p": [1, 2]}')], f"{KEYS}, text string")
    held.append(rows.select("entity_key", "event_timestamp", "a", F.parse_json("text").alias("extra")))
    assert held.read().select(field_of(F.col("extra"), "p", "array<long>")).first()[0] == [1, 2]
    with pytest.raises(ValueError, match="must be VARIANT"):
        held.append(rows.withColumnRenamed("text", "extra"))
    with pytest.raises(ValueError, match="must be VARIANT"):
        held.append(rows.withColumn("extra", F.parse_json("text")))


def test_names_that_are_taken(spark):
    for name in ("a", "entity_key", "batch", "no"):
        with pytest.raises(ValueError, match="taken"):
            FeatureView("v", "user", (Feature("a"),), tie="no", extra=name)
    with pytest.raises(ValueError, match="quote"):
        field_of(F.col("extra"), "it's", "long")


def test_empty_batch_and_bad_json(spark, tmp_path):
    held = table(spark, tmp_path)
    held.append(spark.createDataFrame([], f"{KEYS}, n long"))
    assert held.read().collect() == [] and "extra" in held.read().columns
    texts = spark.createDataFrame([('{"k": 3}',), ('{"k": "x"}',), ("{",), ("",), (None,), ("[1]",)], "j string")
    assert [r[0] for r in texts.select(json_field(F.col("j"), "k", "long")).collect()] == [3, None, None, None, None, None]
