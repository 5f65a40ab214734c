"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from check import TABLES, rows_of
from tidemark.operators.slicing import SkewPolicy
from tidemark.plans import views as V
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    assert name in ORACLES
    got = QUERIES[name](spark, SF).toArrow()
    want = db.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_rolling_sums_of_large_keys(spark):
    events = V.table(spark, SF, "events")
    plain = V.user_fraud(events, SkewPolicy(detect=False))
    cut = V.user_fraud(events, SkewPolicy(rows_per_slice=10))
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) <= set(queries())


def test_late_rows_beside_events_of_the_last_second(spark, tmp_path):
    at = "timestamp_ntz'2024-01-31' + make_interval(0, 0, 0, 0, 0, 0, {} / 1000)"
    views = {1: -90_000, 3: -500, 6: 0, 9: 700, 12: -90_000_000}
    events = [f"({10 * u}, {at.format(ms)}, {u}L, 'view', {u} + 0.5D)" for u, ms in views.items()]
    events += [f"({10 * u + 1}, {at.format(-5_000)}, {u}L, 'signup', 0D)" for u in (*views, 15, 16)]
    columns = "event_id, ts, user_id, event_type, value"
    made = spark.sql(f"SELECT *, '{{\"k\": 1}}' AS props FROM VALUES {', '.join(events)} AS t({columns})")
    made.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["store_parity_late"](spark, str(tmp_path)).toArrow()
    own = duckdb.connect()
    own.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows_of(got) == rows_of(own.sql(ORACLES["store_parity_late"]).to_arrow_table())
    assert sorted(got["entity_key"].to_pylist(), key=int) == ["3", "6", "9", "12", "15"]
