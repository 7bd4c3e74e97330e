"""The tolerance join, curation and look-backs, with every edge of their rules."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rackpulse import schemas
from rackpulse.operators import lookback, series
from rackpulse.operators.series import SECOND, curate_samples, tolerance_join
from rackpulse.operators.skew import last_wins, keyed_join

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def raw(spark, bmc, host, run="20240101_000000", seq=0):
    rows = [(run, seq, "h1", "real", "production", "bmc", at(t), {k: str(v) for k, v in r.items()}) for t, r in bmc]
    rows += [(run, seq, "h1", "real", "production", "host", at(t), {k: str(v) for k, v in r.items()}) for t, r in host]
    return spark.createDataFrame(rows, schemas.SAMPLE_RAW)


BMC = [(5, {"power": 120.0, "inlet_temp": 20.0, "cpu_power": 40.0, "Fan1": 3000.0}), (10, {"power": -2}),
       (15, {"power": 130.0, "inlet_temp": 21.0})]
HOST = [(4, {"cpuload_total": 1.0, "util": 1}), (4.5, {"cpuload_total": -1.0, "util": -1}),
        (5.9, {"cpuload_total": 5.0, "util": 1, "power_p0": 60, "power_p1": 62}), (10, {"cpuload_total": 9.0, "util": 1}),
        (14.5, {"cpuload_total": 2.0, "util": 1}), (15, {"cpuload_total": 3.0, "util": 1})]


def test_curation_without_drift(spark):
    rows = {r["bmc_ts"]: r for r in curate_samples(raw(spark, BMC, HOST)).collect()}
    assert set(rows) == {at(5), at(15)}
    assert (rows[at(5)]["host_ts"], rows[at(5)]["power_px"], rows[at(5)]["cpuload_total"]) == (at(5.9), 122.0, 5.0)
    assert rows[at(15)]["cpuload_total"] == 2.0
    assert rows[at(5)]["extra"] == {"Fan1": 3000.0}


def test_curation_with_drift(spark):
    rows = {r["bmc_ts"]: r for r in curate_samples(raw(spark, BMC, HOST), drift_us=SECOND // 2).collect()}
    assert rows[at(5)]["host_ts"] == at(4)
    assert rows[at(15)]["host_ts"] == at(14.5)


def test_later_run_wins_and_runs_do_not_mix(spark):
    first = raw(spark, [(5, {"power": 1.0})], [(5, {"cpuload_total": 1.0})])
    second = raw(spark, [(5, {"power": 2.0})], [(5, {"cpuload_total": 2.0})], seq=1)
    other = raw(spark, [(50, {"power": 3.0})], [], seq=2).unionByName(raw(spark, [], [(50, {"cpuload_total": 3.0})], seq=3))
    rows = curate_samples(first.unionByName(second).unionByName(other)).collect()
    assert [(r["power"], r["cpuload_total"], r["seq"]) for r in rows] == [(2.0, 2.0, 1)]


def test_host_reading_replaces_bmc_reading(spark):
    row = curate_samples(raw(spark, [(5, {"power": 1.0, "x": 1})], [(5, {"power": 7.0, "x": 2, "net": [1]})])).first()
    assert (row["power"], row["extra"]) == (7.0, {"x": 2.0})


@pytest.mark.parametrize("seed,tolerance,drift", [(1, 5, 0), (2, 90, 7), (3, 400, -3), (4, 1000, 11)])
def test_join_equals_nested_loop(spark, seed, tolerance, drift):
    rng = random.Random(seed)
    span = 5000
    bmc = [(rng.choice("ab"), t) for t in sorted(rng.sample(range(span), 150))]
    host = [(rng.choice("ab"), t) for t in sorted(rng.sample(range(span), 200))]
    tol, dr = tolerance * SECOND, drift * SECOND
    expected = set()
    for k, b in bmc:
        near = [h for j, h in host if j == k and abs(b - drift - h) < tolerance]
        if near:
            expected.add((k, b, min(near)))
    frame = lambda rows: spark.createDataFrame([(k, t * SECOND) for k, t in rows], "k string, t bigint")
    got = tolerance_join(frame(bmc), frame(host), ["k"], tol, dr).collect()
    assert {(r["k"], r["bmc_row"]["t"] // SECOND, r["host_row"]["t"] // SECOND) for r in got} == expected
    assert len(got) == len(expected)


def test_join_edge_is_strict(spark):
    frame = lambda *ts: spark.createDataFrame([(t,) for t in ts], "t bigint")
    assert tolerance_join(frame(10 * SECOND), frame(9 * SECOND, 11 * SECOND), []).count() == 0
    got = tolerance_join(frame(10 * SECOND), frame(9 * SECOND, 9 * SECOND + 1, 11 * SECOND - 1), []).first()
    assert got["host_row"]["t"] == 9 * SECOND + 1


def test_join_builds_no_pairs(spark):
    frame = spark.range(10).select(F.lit("k").alias("k"), (F.col("id") * SECOND).alias("t"))
    plan = tolerance_join(frame, frame, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_last_wins_limits_before_shuffle(spark):
    rows = spark.createDataFrame([(1, i, str(i)) for i in range(100)] + [(2, 5, "x")], "k int, o int, v string")
    kept = last_wins(rows, ["k"], ["o"])
    assert {(r["k"], r["v"]) for r in kept.collect()} == {(1, "99"), (2, "x")}
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_keyed_join_keeps_rows(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    assert keyed_join(big, small, ["k"]).count() == 667
    assert keyed_join(big, small, ["k"], "left").count() == 1000


def measures(spark, rows):
    return spark.createDataFrame(
        [(h, m, START + timedelta(hours=t), 300.0, float(v)) for h, m, t, v in rows], schemas.MEASURE
    )


LOGIN, LOAD, POWER = lookback.LOGIN, lookback.LOAD, lookback.POWER


@pytest.mark.parametrize("series_,expected", [
    ([(-30, 5.0), (40, -1)], -1.0),                       # out of the day on both sides
    ([(25, -1), (30, -3), (47, -2), (60, 1)], -1.0),      # only codes
    ([(25, 0), (26, -1), (60, 1)], 0.0),                  # zero, then a code
    ([(25, 7), (26, 0), (60, 1)], 7.0),                   # a later zero does not hide a positive
    ([(25, 7), (26, 9), (60, 1)], 9.0),                   # most recent positive
    ([(24, 7), (48, 9), (60, 1)], -1.0),                  # both ends are open
    ([(25, 7), (47, 9)], 7.0),                            # the newest of the series is left out
    ([(47, 9)], -1.0),
])
def test_load_lookback(spark, series_, expected):
    rows = [("h", LOGIN, 24, 1), ("h", LOGIN, 48, 2)] + [("h", LOAD, t, v) for t, v in series_]
    got = lookback.lookbacks(measures(spark, rows)).collect()
    assert [(r["login_count"], r["load_avg"]) for r in got] == [(2.0, expected)]


def test_power_lookback_and_single_login(spark):
    rows = [("h", LOGIN, 24, 1), ("h", LOGIN, 48, 0), ("h", POWER, 30, 100), ("h", POWER, 31, 0), ("h", POWER, 32, -2),
            ("h", POWER, 33, 200), ("h", POWER, 34, 900), ("i", LOGIN, 48, 3), ("i", LOAD, 30, 3)]
    got = {r["host"]: r["mean_power"] for r in lookback.lookbacks(measures(spark, rows)).collect()}
    assert got == {"h": 150.0}


def test_latest_measures(spark):
    rows = [("h", LOGIN, 1, 1), ("h", LOAD, 1, 4), ("h", LOAD, 3, 6), ("h", LOAD, 2, 5)]
    got = {(r["metric"], r["value"]) for r in lookback.latest_measures(measures(spark, rows)).collect()}
    assert got == {(LOAD, 6.0)}


def test_aligned_samples(spark):
    rows = measures(spark, [("h", LOAD, 0, 1), ("h", LOAD, 0.5, 2), ("h", LOAD, 1, 3)])
    got = series.aligned_samples(rows, ["host"], "ts", "value", 3600).orderBy("window_start").collect()
    assert [(r["value"], r["n"]) for r in got] == [(2.0, 2), (3.0, 1)]
