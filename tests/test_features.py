"""Ranks, medians, encoding, balancing, splits, correlation and profiles."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rackpulse import schemas
from rackpulse.operators import features as feat
from rackpulse.operators import profile, ranking
from rackpulse.operators.features import EncodeOptions


def test_rank_in_group_equals_row_number(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), i, rng.randrange(10**6)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id bigint, o bigint")
    ranked = ranking.rank_in_group(df, ["g"], F.floor(F.col("o") / 1000), ["o", "id"], "r").collect()
    for g in "ab":
        mine = sorted((o, i) for h, i, o in rows if h == g)
        assert {(r["o"], r["id"]): r["r"] for r in ranked if r["g"] == g} == {k: n + 1 for n, k in enumerate(mine)}


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [3.0, 3.0, 3.0, 9.0], [-5.0, 0.0, 1e18, 0.001, -1e-9], [float(i % 7) for i in range(100)],
])
def test_exact_median(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, value double")
    counts = df.groupBy("g", "value").agg(F.count("*").alias("n"))
    assert ranking.exact_medians(counts, ["g"]).first()["median"] == statistics.median(values)


def samples(spark, rows):
    names = ["host", "power", "util", "cpuload_total", "loadavg", "inlet_temp", "cpu_power", "extra"]
    kinds = "host string, power double, util double, cpuload_total double, loadavg double, inlet_temp double, cpu_power double, extra map<string,double>"
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)
    others = [f for f in schemas.SAMPLE_CURATED.fields if f.name not in names]
    return df.select(*names, *[F.lit(None).cast(f.dataType).alias(f.name) for f in others if f.name != "bmc_ts"],
                     F.timestamp_seconds(F.monotonically_increasing_id()).alias("bmc_ts"))


GOOD = {"host": "a", "power": 10.0, "util": 1.0, "cpuload_total": 5.0, "loadavg": 0.5, "extra": {}}


def test_encoding_drops_negative_and_incomplete_rows(spark):
    rows = [GOOD, {**GOOD, "power": -2.0}, {**GOOD, "util": -1.0}, {**GOOD, "cpuload_total": -1.0}, {**GOOD, "power": None},
            {**GOOD, "cpuload_total": None}, {**GOOD, "util": None}]
    got = feat.encode_samples(samples(spark, rows), EncodeOptions(cpuload="class")).collect()
    assert [(r["overall_power"], r["util"], r["load"]) for r in got] == [(10.0, 1, 1), (10.0, 1, 1)]


def test_encoding_selected_sensors(spark):
    rows = [{**GOOD, "inlet_temp": 20.0}, {**GOOD, "inlet_temp": -1.0}, GOOD]
    assert feat.encode_samples(samples(spark, rows), EncodeOptions()).count() == 3
    assert feat.encode_samples(samples(spark, rows), EncodeOptions(inlet_temp=True)).count() == 1


def test_cpu_power_from_sockets_and_override(spark):
    sockets = {"CPU1 Power": 3.0, "CPU2 Power": 4.0}
    rows = [{**GOOD, "extra": sockets}, {**GOOD, "extra": sockets, "cpu_power": 9.0},
            {**GOOD, "extra": {**sockets, "CPU2 Power": -1.0}}, {**GOOD, "cpu_power": -1.0}, GOOD, {**GOOD, "host": "b"}]
    got = feat.encode_samples(samples(spark, rows), EncodeOptions(cpu_power=True)).collect()
    # Host b never reports the sensor and keeps its row; host a's row without it goes.
    assert sorted((r["host"], r["cpu_power"]) for r in got if r["host"] == "a") == [("a", 7.0), ("a", 9.0)]
    assert [(r["host"], r["cpu_power"]) for r in got if r["host"] == "b"] == [("b", None)]


def test_fans_and_load_average_truth(spark):
    rows = [{**GOOD, "extra": {"Fan1": 30.0}}, {**GOOD, "extra": {"Fan1": -1.0}}, {**GOOD, "loadavg": -1.0, "extra": {"Fan1": 3.0}}]
    options = EncodeOptions(fans=("Fan1",), truth="loadavg", timestamp=False)
    got = feat.encode_samples(samples(spark, rows), options)
    assert got.columns == ["host", "overall_power", "Fan1", "util", "load"]
    assert [(r["Fan1"], r["load"]) for r in got.collect()] == [(30.0, 1)]


def labelled(spark, sizes):
    rows = [(i * 10 + c, c) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, load int")


@pytest.mark.parametrize("sizes,expected", [((5, 3, 4, 2), 2), ((5, 0, 4, 2), 0), ((700, 300, 400, 350), 300)])
def test_balanced_sample(spark, sizes, expected):
    df = labelled(spark, sizes)
    got = feat.balanced_sample(df, "load", (0, 1, 2, 3), F.col("id"), seed=3)
    counts = {r["load"]: r["n"] for r in feat.label_counts(got, "load").collect()}
    assert counts == ({c: expected for c in range(4)} if expected else {})
    assert got.count() == got.distinct().count()
    other = feat.balanced_sample(df, "load", (0, 1, 2, 3), F.col("id"), seed=4)
    if expected == 300:
        assert {r["id"] for r in got.collect()} != {r["id"] for r in other.collect()}
        assert {r["id"] for r in got.collect()} == {
            r["id"] for r in feat.balanced_sample(df.repartition(7), "load", (0, 1, 2, 3), F.col("id"), seed=3).collect()
        }


def test_machine_split(spark):
    rows = [("g1", f"m{i}", i) for i in range(5)] + [("g2", "only", 9)]
    members = spark.createDataFrame(rows, "g string, m string, p bigint")
    listed = {r["m"]: r["part"] for r in feat.machine_split(members, "g", "m", "p", "linear").collect()}
    assert listed == {"m0": "train", "m1": "train", "m2": "test", "m3": "test", "m4": "test", "only": "train"}
    shuffled = [r["part"] for r in feat.machine_split(members, "g", "m", "p", "random", 5).collect()]
    assert sorted(shuffled) == ["test"] * 3 + ["train"] * 3


def test_correlations_like_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300) * 1.0, "b": rng.normal(size=300), "flat": 1.0})
    pdf["load"] = pdf["a"] * 2 + rng.normal(size=300)
    df = spark.createDataFrame(pdf)
    for method, operator in (("pearson", feat.correlation_with_label), ("spearman", feat.spearman_with_label)):
        got = {r["feature"]: r["corr"] for r in operator(df, ["a", "b", "flat"], "load").collect()}
        ranks = pdf.rank() if method == "spearman" else pdf
        for c in ("a", "b"):
            assert got[c] == pytest.approx(ranks[c].corr(ranks["load"]), abs=1e-9)
        assert got["flat"] is None
    facts = feat.training_facts(df, ["a", "flat"], "load")
    assert (facts.features, facts.n_rows) == (["a"], 300)
    assert facts.label_deviation == pytest.approx(pdf["load"].std(ddof=0))


def test_load_range_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 5.0, 10.0, 10.5)], "load double")
    assert df.where(feat.in_load_range("load", 0.0, 10.0)).count() == 3
    assert df.where(feat.in_load_range("load", 5.0, 10.0)).count() == 1


def test_load_bins(spark):
    loads = [0.0, 20.0, 20.5, 40.0, 60.0, 100.0, 100.5]
    df = spark.createDataFrame([(x, x + 1) for x in loads], "load double, power double")
    got = {r["bin"]: r for r in profile.load_bin_profile(df, "load", ["power"]).collect()}
    assert {b: r["n"] for b, r in got.items()} == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}
    assert (got[0]["median"], got[1]["min"], got[1]["max"]) == (11.0, 21.5, 41.0)
    assert got[0]["stddev"] == pytest.approx(np.std([1, 21], ddof=1))
    assert got[2]["stddev"] is None and got[3]["median"] is None


def test_class_counts_of_raw_loads(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 5.0), ("a", 1, 50.0)], "host string, util int, load double")
    got = feat.class_counts(df, ["host"], as_classes=False).first()
    assert [got[c] for c in ("n", "u0", "u1", "l0", "l1", "l2", "l3", "nonzero")] == [3, 1, 2, 1, 1, 0, 1, 2]


def test_features_with_gaps_are_not_used(spark):
    df = spark.createDataFrame([(1.0, None, None, 1.0), (2.0, 3.0, None, 2.0)], "a double, b double, cpu_power double, load double")
    assert feat.training_facts(df, ["a", "b", "cpu_power"], "load").features == ["a"]


def test_ranks_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(feat, "RANK_ROWS", 100)
    rows = spark.range(300).selectExpr("cast(id % 7 as double) a", "cast(id as double) b", "1.0 c")
    found = feat.spearman_matrix(rows, ["a", "b", "c"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" in plan and ", 9)" in plan
    got = {(r["a"], r["b"]): r["corr"] for r in found.collect()}
    table = rows.toPandas().corr("spearman")
    assert abs(got["a", "b"] - table.loc["a", "b"]) < 1e-9 and got["a", "c"] is None


def test_fans_are_read_once_for_check_and_value(spark):
    rows = [("h1", {"Fan1": 10.0, "x": 1.0}, 5.0), ("h2", {"Fan1": -1.0}, None), ("h3", {"FAN2": None}, None), ("h4", None, None), ("h5", {"fan_power": 1.0}, 7.0)]
    samples = spark.createDataFrame(rows, "host string, extra map<string,double>, fan_power double")
    names = feat.fan_dictionary(samples)
    assert {r["name"]: (r["code"], r["n_samples"]) for r in names.collect()} == {"FAN2": (0, 1), "Fan1": (1, 2), "fan_power": (2, 2)}
    found = feat.with_fans(samples, names)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_filter") == 1 and found.columns == ["host", "extra", "fan_power", "fans"]
    got = {r["host"]: [tuple(f) for f in r["fans"]] for r in found.collect()}
    assert got == {"h1": [(1, 10.0), (2, 5.0)], "h4": [], "h5": [(2, 7.0)]}
