"""Evaluation figures, neighbours, estimators and experiments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rackpulse.models import estimators, experiment
from rackpulse.operators import evaluate, neighbours
from rackpulse.operators.profile import outcome_buckets
from rackpulse.sinks import tables


def outcomes(spark, pairs):
    return evaluate.outcome_counts(spark.createDataFrame(pairs, "a int, p int"), "a", "p")


def test_confusion_accuracy_auc(spark):
    found = outcomes(spark, [(0, 0), (0, 1), (1, 1), (1, 1)])
    assert evaluate.accuracy(found).first()["accuracy"] == 0.75
    assert {r["class"]: r["auc"] for r in evaluate.one_vs_rest_auc(found, (0, 1)).collect()} == {0: 0.75, 1: 0.75}
    shares = {(r["actual"], r["predicted"]): r["pct"] for r in evaluate.confusion_percent(found, (0, 1, 2)).collect()}
    assert shares[(0, 0)] == shares[(0, 1)] == 50.0 and shares[(1, 0)] == 0.0 and shares[(1, 1)] == 100.0
    assert shares[(2, 0)] is None
    old = {(r["actual"], r["predicted"]): r["pct"] for r in evaluate.confusion_percent(found, (0, 1, 2), True).collect()}
    assert (old[(2, 0)], old[(2, 1)]) == (100.0, 0.0)


def test_auc_equals_pairwise_definition(spark):
    rng = np.random.default_rng(1)
    a, p = rng.integers(0, 4, 200), rng.integers(0, 4, 200)
    got = {r["class"]: r["auc"] for r in evaluate.one_vs_rest_auc(outcomes(spark, list(zip(a.tolist(), p.tolist()))), (0, 1, 2, 3)).collect()}
    for c in range(4):
        pos, neg = (p[a == c] == c) * 1.0, (p[a != c] == c) * 1.0
        gap = pos[:, None] - neg[None, :]
        assert got[c] == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())


def test_auc_of_unseen_prediction_and_single_class(spark):
    got = {r["class"]: r["auc"] for r in evaluate.one_vs_rest_auc(outcomes(spark, [(0, 0), (0, 3), (1, 1)]), (0, 1, 2, 3)).collect()}
    assert got == {0: 1.0, 1: 0.75}
    assert [r["auc"] for r in evaluate.one_vs_rest_auc(outcomes(spark, [(0, 0)]), (0, 1)).collect()] == [None]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 4.0)], "y double, p double")
    row = evaluate.regression_metrics(df, "y", "p", 1).first()
    assert (row["rmse"], row["mae"]) == (pytest.approx(0.57735, abs=1e-5), pytest.approx(1 / 3))
    assert (row["r2"], row["adjr2"]) == (pytest.approx(0.5), pytest.approx(0.0))


def test_outcome_buckets(spark):
    df = spark.createDataFrame([(0, 1, 5.0), (0, 1, 9.0), (1, 1, 12.0)], "a int, p int, v double")
    got = {(r["actual"], r["predicted"], r["bucket"]): r["n"] for r in outcome_buckets(df, "a", "p", "v", 10.0).collect()}
    assert got == {(0, 1, 0): 2, (1, 1, 1): 1}


@pytest.mark.parametrize("dims,block,k", [(1, 40, 5), (3, 25, 11), (2, 8192, 3), (2, 7, 400)])
def test_neighbours_equal_brute_force(spark, dims, block, k):
    rng = np.random.default_rng(dims)
    points = np.round(rng.normal(size=(300, dims)) * (rng.random((300, 1)) < 0.7), 1)  # a third at the origin
    queries = np.round(rng.normal(size=(60, dims)), 1)
    train = spark.createDataFrame([(i, p.tolist(), float(i % 3)) for i, p in enumerate(points)], "id bigint, x array<double>, y double")
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "id bigint, x array<double>")
    found = neighbours.nearest_neighbours(train, asked, "id", "id", "x", "y", k, block_rows=block).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["train_id"])
    for i, q in enumerate(queries):
        gaps = np.sqrt(((points - q) ** 2).sum(axis=1))
        assert got[i] == set(np.lexsort((np.arange(300), gaps))[:k].tolist())


def test_neighbour_vectors_are_not_copied_for_each_cell(spark):
    rows = [(i, [float((i * 7919 + j * 104729) % 101) for j in range(16)], float(i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, y double")
    found = neighbours.nearest_neighbours(df, df, "id", "id", "x", "y", 5, block_rows=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan and "CoGroup" not in plan
    assert found.count() == 400 * 5


def test_vote_and_mean(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, 0.0), (2, 5.0), (2, 3.0)], "query_id bigint, label double")
    assert {r["query_id"]: r["prediction"] for r in neighbours.vote(df).collect()} == {1: 2.0, 2: 3.0}
    assert {r["query_id"]: r["prediction"] for r in neighbours.mean_label(df).collect()} == {1: 4 / 3, 2: 4.0}


def line(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x, z = rng.uniform(50, 300, n), rng.uniform(10, 30, n)
    y = 0.3 * x - 15 + 0.2 * z + rng.normal(size=n)
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "overall_power double, inlet_temp double, load double")


FEATURES = ["overall_power", "inlet_temp"]


@pytest.mark.parametrize("method,floor", [
    ("lir", 0.99), ("rir", 0.99), ("knnr", 0.9), ("svr_lin", 0.99), ("svr_poly", 0.99), ("svr_rbf", 0.9),
])
def test_regressors(spark, method, floor, tmp_path):
    df = line(spark).cache()
    model = estimators.fit(df, "reg", method, FEATURES, "load")
    assert evaluate.regression_metrics(model.transform(df), "load", "prediction", 2).first()["r2"] > floor
    model.save(str(tmp_path / method))
    again = (
        estimators.load_neighbours(spark, str(tmp_path / method), FEATURES, "load", True) if method == "knnr"
        else estimators.load(str(tmp_path / method), FEATURES, "load")
    )
    total = lambda m: m.transform(df).agg(F.sum("prediction")).first()[0]
    assert total(again) == pytest.approx(total(model))


def test_ridge_equals_closed_form(spark):
    df = line(spark, 50)
    pdf = df.toPandas()
    x = pdf[FEATURES].to_numpy()
    xc, yc = x - x.mean(axis=0), pdf["load"] - pdf["load"].mean()
    expected = np.linalg.solve(xc.T @ xc + 0.1 * np.eye(2), xc.T @ yc)
    model = estimators.fit(df, "reg", "rir", FEATURES, "load")
    assert np.allclose(model.pipeline.stages[-1].coefficients.toArray(), expected, atol=1e-7)


def classes(spark):
    rows = [("h%d" % (i % 4), i, 100.0 * (c + 1) + i % 7, 20.0 + c, int(c > 0), c) for i in range(40) for c in range(4)]
    return spark.createDataFrame(rows, "host string, time bigint, overall_power double, inlet_temp double, util int, load int")


@pytest.mark.parametrize("method", estimators.CLASSIFIERS)
def test_classifiers(spark, method, tmp_path):
    df = classes(spark).withColumn("load", F.col("load").cast("double")).cache()
    if method == "rf":
        estimators.TREES, kept = 5, estimators.TREES
    model = estimators.fit(df, "multi", method, FEATURES, "load")
    if method == "rf":
        estimators.TREES = kept
        assert set(model.importances()) == set(FEATURES)
    found = evaluate.outcome_counts(model.transform(df), "load", "prediction")
    assert evaluate.accuracy(found).first()["accuracy"] > 0.95
    if method == "lor":
        tables.model(model, str(tmp_path), method)
        assert spark.read.csv(str(tmp_path / "coefficients"), header=True).columns == FEATURES
        again = estimators.load(str(tmp_path / "model"), FEATURES, "load").transform(df)
        assert again.where("prediction = load").count() > 150
        frame = model.coefficients(spark)
        assert frame.columns == FEATURES and frame.count() == 4


def test_method_must_fit_task():
    with pytest.raises(ValueError):
        estimators.check_method("binary", "svr_rbf")
    with pytest.raises(ValueError):
        estimators.check_method("reg", "rf")


def test_experiments_on_machine_lists(spark):
    hosts = lambda *names: spark.createDataFrame([(n,) for n in names], "host string")
    task = experiment.Task("binary", "nbc", tuple(FEATURES), lower=0.0, upper=2.0)
    results = experiment.by_machine_lists(classes(spark), hosts("h0", "h1"), hosts("h2"), task, 2)
    got = {(r["part"], r["metric"], r["actual"], r["predicted"]): r["value"] for r in experiment.medians(results).collect()}
    assert got[("train", "accuracy", None, None)] > 0.9 and ("test", "roc_auc", 1, None) in got
    assert results.where("metric = 'accuracy'").count() == 4


def test_empty_class_is_skipped(spark):
    task = experiment.Task("multi", "nbc", tuple(FEATURES))
    rows, model = experiment.run_one(classes(spark).where("load < 3"), None, task, None, 0)
    assert model is None and rows[0][3] == "skipped"


def test_experiments_per_group(spark):
    members = spark.createDataFrame(
        [("g1", "h0", 0), ("g1", "h1", 1), ("g2", "h2", 2)], "hwconfig string, hostname string, position bigint"
    )
    task = experiment.Task("reg", "lir", ("overall_power",))
    results = experiment.by_hardware_group(classes(spark), members, task, 1, "linear")
    got = {(r["hwconfig"], r["part"]) for r in results.where("metric = 'rmse'").collect()}
    assert got == {("g1", "train"), ("g1", "test"), ("g2", "train")}


def test_score_saved_model(spark):
    df = line(spark)
    task = experiment.Task("reg", "lir", tuple(FEATURES), lower=10.0, upper=50.0)
    model = estimators.fit(df, "reg", "lir", FEATURES, "load")
    scored, figures = experiment.score_saved(model, df, task)
    assert {"actual_cpu_load", "detected_cpu_load"} <= set(scored.columns)
    assert scored.where("actual_cpu_load <= 10 OR actual_cpu_load > 50").count() == 0
    assert {r["metric"] for r in figures.collect()} == {"rmse", "mae", "r2", "adjr2"}
