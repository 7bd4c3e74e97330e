"""Experiments of all groups at once beside one fit after another."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.models import estimators, experiment, grouped
from rackpulse.operators import evaluate

FEATURES = ("overall_power", "exhaust_temp", "steady")
SCHEMA = "host string, overall_power double, exhaust_temp double, steady double, util int, load double, extra string"


def samples(spark, hosts=9, per_host=60, classes=4):
    rng = np.random.default_rng(5)
    rows = []
    for h in range(hosts):
        for _ in range(per_host):
            load = int(rng.integers(0, classes))
            power = 100 + 30 * load + rng.normal(0, 12)
            rows.append((f"h{h}", float(power), float(20 + power / 40 + rng.normal()), 7.0, int(load > 0), float(load), "x"))
    return spark.createDataFrame(rows, SCHEMA)


def members(spark):
    groups = [("g1", i) for i in range(4)] + [("g2", i) for i in (4, 5, 6)] + [("g3", 7), ("g4", 90)]
    return spark.createDataFrame([(g, f"h{i}", i) for g, i in groups], "hwconfig string, hostname string, position bigint")


def figures(results):
    return {(r["hwconfig"], r["part"], r["experiment"], r["metric"], r["actual"], r["predicted"]): r["value"] for r in results.collect()}


def one_by_one(rows, parts, task):
    """The same experiments by the MLlib estimators, group after group, on the very rows the grouped form chose."""
    found = {}
    for p in parts.select("hwconfig", "experiment").distinct().collect():
        mine = parts.where((F.col("hwconfig") == p["hwconfig"]) & (F.col("experiment") == p["experiment"]))
        of = lambda name: rows.join(mine.where(F.col("part") == name).select("host"), "host", "left_semi").withColumn("load", F.col("load").cast("double"))  # noqa: E731, B023
        train, test = of("train"), of("test").where(F.col("load").between(task.lower, task.upper))
        facts = experiment.feat.training_facts(train, list(task.features), task.label)
        model = estimators.fit(train, task.ctype, task.method, facts.features, task.label, facts)
        for name, df in (("train", train), ("test", test)):
            if df.isEmpty():
                continue
            for r in experiment.metrics(model.transform(df), task, len(facts.features)).collect():
                found[(p["hwconfig"], name, p["experiment"], r["metric"], r["actual"], r["predicted"])] = r["value"]
    return found


@pytest.mark.parametrize("method", ["lir", "rir"])
def test_regressions_equal_single_fits(spark, method):
    rows, task = samples(spark), experiment.Task("reg", method, FEATURES)
    parts = grouped.group_parts(rows, members(spark), 2, "random", 3).cache()
    assert {r["hwconfig"] for r in parts.collect()} == {"g1", "g2", "g3"}  # g4 has no samples
    got = figures(grouped.experiments(rows, parts, task).where("status = 'ok'"))
    want = one_by_one(rows, parts, task)
    assert set(got) == set(want) and len(want) == 2 * (2 + 2 + 1) * 4
    assert all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_bayes_equals_single_fits_on_balanced_rows(spark):
    # Equal classes on every machine, so balancing keeps every row and both forms see the same.
    rows = spark.createDataFrame(
        [(f"h{h}", 100.0 + 40 * c + (7 * i + 3 * h) % 50, 30.0 + c * 2 + (5 * i + h) % 9, 7.0, int(c > 0), float(c), "x")
         for h in range(8) for c in range(4) for i in range(20)], SCHEMA)
    task = experiment.Task("multi", "nbc", FEATURES)
    parts = grouped.group_parts(rows, members(spark), 1, "linear", 0).cache()
    got = figures(grouped.experiments(rows, parts, task).where("status = 'ok'"))
    want = one_by_one(rows, parts, task)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert 0.4 < got[("g1", "test", 0, "accuracy", None, None)] < 1


def test_balanced_takes_the_smallest_class_of_each_group(spark):
    rows = spark.range(5000).select(
        (F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("util"), F.col("id").alias("k"))
    rows = rows.unionByName(spark.createDataFrame([("alone", 1, 9000 + i) for i in range(5)], "g string, util int, k long"))
    kept = grouped.balanced(rows, ["g"], "util", (0, 1), F.col("k"), F.lit(4)).cache()
    sizes = {(r["g"], r["util"]): r["count"] for r in kept.groupBy("g", "util").count().collect()}
    small = {r["g"]: r["count"] for r in rows.where("util = 1 AND g != 'alone'").groupBy("g").count().collect()}
    assert sizes == {(g, u): n for g, n in small.items() for u in (0, 1)}
    order = grouped.shuffled_order(F.col("k"), 4)
    last = kept.where("util = 0").groupBy("g").agg(F.max(order).alias("last"))
    earlier = rows.where("util = 0").join(last, "g").where(order < F.col("last")).groupBy("g").count().collect()
    assert {r["g"]: r["count"] + 1 for r in earlier} == small


def test_skipped_groups_and_null_features(spark):
    rows = samples(spark).withColumn("load", F.when(F.col("host") == "h7", 2.0).otherwise(F.col("load")))
    task = experiment.Task("multi", "nbc", ("overall_power", "exhaust_temp"), upper=-1.0)
    got = experiment.by_hardware_group(rows, members(spark), task, 1, "linear").collect()
    skipped = {(r["hwconfig"], r["part"]) for r in got if r["status"] == "skipped"}
    assert skipped == {("g3", "train"), ("g1", "test"), ("g2", "test")}  # an empty class; no test rows within the bounds
    holes = samples(spark).withColumn("exhaust_temp", F.when(F.rand(1) > 0.5, F.col("exhaust_temp")))
    task = experiment.Task("reg", "lir", ("overall_power", "exhaust_temp"))
    alone = figures(experiment.by_hardware_group(holes, members(spark), experiment.Task("reg", "lir", ("overall_power",)), 1, "linear"))
    assert figures(experiment.by_hardware_group(holes, members(spark), task, 1, "linear")) == pytest.approx(alone)


def test_lists_are_one_group(spark):
    rows, task = samples(spark), experiment.Task("reg", "rir", FEATURES)
    hosts = lambda *names: spark.createDataFrame([(n,) for n in names], "host string")
    got = figures(experiment.by_machine_lists(rows, hosts("h0", "h1"), hosts("h2"), task, 2))
    assert {k[0] for k in got} == {None} and {k[2] for k in got} == {0, 1}
    train = rows.where("host IN ('h0', 'h1')")
    model = estimators.fit(train, "reg", "rir", list(FEATURES[:2]), "load")
    want = evaluate.regression_metrics(model.transform(rows.where("host = 'h2'")), "load", "prediction", 2).first()
    assert got[(None, "test", 1, "rmse", None, None)] == pytest.approx(want["rmse"], rel=1e-6)


def test_number_of_jobs_does_not_follow_the_groups(spark):
    def jobs(groups):
        rows = samples(spark, hosts=groups * 2, per_host=8)
        machines = spark.createDataFrame([(f"g{i % groups}", f"h{i}", i) for i in range(groups * 2)], "hwconfig string, hostname string, position bigint")
        spark.sparkContext.setJobGroup(f"groups-{groups}", "")
        experiment.by_hardware_group(rows, machines, experiment.Task("reg", "lir", ("overall_power",)), 1, "linear").count()
        found = spark.sparkContext.statusTracker().getJobIdsForGroup(f"groups-{groups}")
        spark.sparkContext.setJobGroup("", "")
        return len(found)

    assert abs(jobs(2) - jobs(40)) <= 3
