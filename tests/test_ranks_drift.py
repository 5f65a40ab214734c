import math

import numpy as np
import pytest

from tidemark.operators import drift, profile
from tidemark.operators.ranks import interpolated, nearest_rank
from tidemark.operators.slicing import SkewPolicy

POLICIES = [SkewPolicy(detect=False), SkewPolicy(rows_per_slice=20)]
SHARES = [i / 10 for i in range(11)]


def samples():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(size=400),
        "few": rng.integers(0, 4, size=300).astype(float),
        "same": np.full(50, 2.5),
        "tail": np.exp(rng.normal(size=500) * 6),
        "one": np.array([1.5]),
    }


def frame(spark, data, side=None):
    rows = [(n, float(x)) for n, xs in data.items() for x in xs]
    rows += [(next(iter(data)), None), (next(iter(data)), float("nan"))]
    return spark.createDataFrame(rows, "feature string, value double")


@pytest.mark.parametrize("policy", POLICIES)
def test_interpolated_quantiles_equal_numpy(spark, policy):
    data = samples()
    got = interpolated(
        frame(spark, data), "value", SHARES, "q", by="feature", names=list(data), policy=policy
    )
    for r in got.collect():
        want = np.percentile(data[r.feature], [100 * s for s in SHARES])
        assert r.n == len(data[r.feature])
        np.testing.assert_allclose(r.q, want, rtol=1e-12)


@pytest.mark.parametrize("policy", POLICIES)
def test_nearest_rank(spark, policy):
    data = samples()["tail"]
    got = nearest_rank(frame(spark, {"x": data}), "value", profile.PERCENTILES, policy=policy)
    row = got.first().asDict()
    for name, p in profile.PERCENTILES.items():
        assert row[name] == sorted(data)[max(math.ceil(p * len(data)) - 1, 0)]


def numpy_psi(base, current, buckets=10):
    edges = np.unique(np.percentile(base, np.linspace(0, 100, buckets + 1)))
    if len(edges) < 2:
        return 0.0
    edges[0], edges[-1] = -np.inf, np.inf
    shares = [np.maximum(np.histogram(x, bins=edges)[0] / len(x), 1e-6) for x in (base, current)]
    return float(np.sum((shares[1] - shares[0]) * np.log(shares[1] / shares[0])))


@pytest.mark.parametrize("policy", POLICIES)
def test_psi_equals_numpy(spark, policy):
    base = samples()
    rng = np.random.default_rng(5)
    current = {n: np.concatenate([x[: len(x) // 2 + 1] * 1.3, rng.choice(x, 20)]) for n, x in base.items()}
    rows = [(n, s, float(x)) for s, d in (("baseline", base), ("current", current)) for n, xs in d.items() for x in xs]
    values = spark.createDataFrame(rows, "feature string, side string, value double")
    got = {r.feature: r for r in drift.psi(values, list(base), policy=policy).collect()}
    assert set(got) == set(base)
    for n, r in got.items():
        assert r.psi == pytest.approx(numpy_psi(base[n], current[n]), rel=1e-9, abs=1e-12)
        assert r.current_mean == pytest.approx(current[n].mean())
    report = {r.feature: r for r in drift.drift_report(values, list(base)).collect()}
    assert report["one"].status == "TOO_FEW_VALUES" and report["one"].psi is None
    assert report["same"].psi == 0.0 and report["same"].status == "NORMAL"
    for n, r in report.items():
        psi = got[n].psi
        if min(r.baseline_count, r.current_count) < drift.MIN_VALUES:
            assert r.status == "TOO_FEW_VALUES"
            continue
        want = "NORMAL" if psi < 0.1 else "MODERATE_DRIFT" if psi < 0.2 else "SIGNIFICANT_DRIFT"
        assert r.status == want
    assert drift.overall_status(drift.drift_report(values, ["same"])).first().overall_status == "NORMAL"
    assert drift.overall_status(drift.drift_report(values, [])).first().overall_status == "NORMAL"
    assert drift.overall_status(drift.drift_report(values, list(base))).first().overall_status == "DRIFT_DETECTED"
    few = drift.overall_status(drift.drift_report(values, ["same", "one", "absent"])).first()
    assert tuple(few) == (1, 2, "INCOMPLETE")


def test_histogram_is_half_open_and_shows_empty_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (0.05, 0.1, 0.2, 0.5, 2.0, 7.0, None)], "v double")
    got = {r.bucket: r.row_count for r in profile.histogram(df, "v").collect()}
    assert got == dict(zip(profile.LABELS, (1, 2, 0, 1, 0, 2)))


def test_basics(spark):
    df = spark.createDataFrame([(1.0, 0), (3.0, 2_000_000)], "v double, at long")
    row = profile.basics(df, "v", at_us=df["at"]).first()
    assert tuple(row) == (2, 1.0, 3.0, 2.0, 1.0)


@pytest.mark.parametrize("policy", POLICIES)
def test_features_of_a_table_are_reported_as_if_named(spark, policy):
    rng = np.random.default_rng(8)
    rows = [(f"f{i}", s, float(x)) for i in range(60) for s in ("baseline", "current") for x in rng.normal(i, 1, 4 + i)]
    values = spark.createDataFrame(rows, "feature string, side string, value double")
    names = [f"f{i}" for i in range(0, 60, 2)] + ["absent"]
    asked = spark.createDataFrame([(n,) for n in names * 2], "feature string")
    got = drift.drift_report(values, asked, policy=policy)
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = drift.drift_report(values, names, policy=policy)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_drift_is_reported_of_every_user(spark):
    from tidemark.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = [r.feature for r in QUERIES["drift_every_user"](spark, sf).collect()]
    users = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null").select("user_id").distinct()
    assert sorted(got) == sorted(str(r.user_id) for r in users.collect())
