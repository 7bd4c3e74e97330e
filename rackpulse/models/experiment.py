"""Training and testing by machine, repeated experiments and their medians."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.models import estimators, grouped
from rackpulse.operators import evaluate, features as feat
from rackpulse.operators.inventory import members_with_samples
from rackpulse.operators.skew import keyed_join
from rackpulse.session import rebalanced, scratch_path

RESULT = (
    "part string, hwconfig string, experiment int, status string, metric string, "
    "actual int, predicted int, value double"
)


@dataclass(frozen=True)
class Task:
    """What to train: task type, method, features and evaluation bounds."""

    ctype: str  # 'binary', 'multi' or 'reg'
    method: str
    features: tuple[str, ...]
    lower: float = 0.0
    upper: float = 100.0
    seed: int = 0

    @property
    def label(self) -> str:
        return feat.LABELS[self.ctype]


def _numbers(df: DataFrame, task: Task) -> DataFrame:
    return df.withColumn(task.label, F.col(task.label).cast("double"))


def training_set(samples: DataFrame, task: Task, seed: int) -> DataFrame:
    """Balanced samples for a class task, all samples for a regression."""
    if task.ctype == "reg":
        return samples
    key = F.xxhash64(*[f"`{c}`" for c in samples.columns])
    return feat.balanced_sample(samples, task.label, feat.CLASSES[task.ctype], key, seed)


def test_set(samples: DataFrame, task: Task) -> DataFrame:
    """Samples within the load bounds; the bounds apply before the load column goes."""
    return samples.where(feat.in_load_range("load", task.lower, task.upper))


def metrics(scored: DataFrame, task: Task, n_features: int) -> DataFrame:
    """Long result rows of one scored frame: metric, actual, predicted, value."""
    none = F.lit(None).cast("int")
    if task.ctype == "reg":
        wide = evaluate.regression_metrics(scored, task.label, "prediction", n_features)
        names = ["rmse", "mae", "r2", "adjr2"]
        return wide.select(*names).unpivot([], names, "metric", "value").select(
            "metric", none.alias("actual"), none.alias("predicted"), "value"
        )
    classes = feat.CLASSES[task.ctype]
    outcomes = evaluate.outcome_counts(scored, task.label, "prediction")
    acc = evaluate.accuracy(outcomes).select(
        F.lit("accuracy").alias("metric"), none.alias("actual"), none.alias("predicted"), F.col("accuracy").alias("value")
    )
    auc = evaluate.one_vs_rest_auc(outcomes, classes).select(
        F.lit("roc_auc").alias("metric"), F.col("class").alias("actual"), none.alias("predicted"), F.col("auc").alias("value")
    )
    share = evaluate.confusion_percent(outcomes, classes).select(
        F.lit("confusion").alias("metric"), "actual", "predicted", F.col("pct").alias("value")
    )
    return acc.unionByName(auc).unionByName(share)


def predictions(scored: DataFrame) -> DataFrame:
    """Prediction rows with both loads by name; host and time stay with every row."""
    return scored.withColumnRenamed("load", "actual_cpu_load").withColumnRenamed("prediction", "detected_cpu_load")


def train(samples: DataFrame, task: Task, seed: int = 0):
    """Fitted model and its cached training frame, or None when a class has no samples."""
    estimators.check_method(task.ctype, task.method)
    chosen = _numbers(training_set(samples, task, seed), task).cache()
    facts = feat.training_facts(chosen, list(task.features), task.label)
    if facts.n_rows == 0:
        chosen.unpersist()
        return None
    return estimators.fit(chosen, task.ctype, task.method, facts.features, task.label, facts), chosen


def _skipped(part: str, group: str | None, experiment: int) -> tuple:
    return (part, group, experiment, "skipped", "accuracy", None, None, None)


def run_one(
    train_samples: DataFrame, test_samples: DataFrame | None, task: Task, group: str | None, experiment: int
) -> tuple[list[tuple], object | None]:
    """Result rows of one experiment (a bounded number) and its model.

    Fit and prediction times are rows too. A training set with an empty class, or
    a test set without rows, gives one row marked skipped.
    """
    started = time.monotonic()
    fitted = train(train_samples, task, task.seed + experiment)
    if fitted is None:
        return [_skipped("train", group, experiment)], None
    model, chosen = fitted
    rows = [("train", group, experiment, "ok", "fit_seconds", None, None, time.monotonic() - started)]

    def score(part: str, df: DataFrame) -> None:
        begin = time.monotonic()
        found = metrics(model.transform(df), task, len(model.features)).collect()
        if all(r["value"] is None for r in found):
            rows.append(_skipped(part, group, experiment))
            return
        rows.extend((part, group, experiment, "ok", *r) for r in found)
        rows.append((part, group, experiment, "ok", "predict_seconds", None, None, time.monotonic() - begin))

    score("train", chosen)
    if test_samples is not None:
        score("test", _numbers(test_set(test_samples, task), task))
    chosen.unpersist()
    return rows, model


def by_machine_lists(
    samples: DataFrame, train_hosts: DataFrame, test_hosts: DataFrame | None, task: Task,
    n_experiments: int = 1, test_source: DataFrame | None = None, key: Column | None = None,
) -> DataFrame:
    """Experiments on given training and test machines (frames with a ``host`` column).

    Methods whose fit follows from sums run all experiments in one pass (see ``grouped``); there ``key`` orders the rows of a class
    when classes are balanced.
    """
    if task.method in grouped.METHODS:
        return grouped.experiments(samples, grouped.list_parts(train_hosts, test_hosts, n_experiments), task, key, test_source)
    chosen = samples.join(train_hosts.select("host"), "host", "left_semi")
    tested = None
    if test_hosts is not None:
        source = samples if test_source is None else test_source
        tested = source.join(test_hosts.select("host"), "host", "left_semi")
    rows: list = []
    for i in range(n_experiments):
        rows += run_one(chosen, tested, task, None, i)[0]
    return samples.sparkSession.createDataFrame(rows, RESULT)


def by_hardware_group(
    samples: DataFrame, members: DataFrame, task: Task, n_experiments: int = 1, selection: str = "random",
    at_once: int = 4, key: Column | None = None,
) -> DataFrame:
    """Experiments per hardware group, each with its own split of the group's machines.

    ``members`` has hwconfig, hostname and position. Methods whose fit follows from sums run all groups and
    experiments in one pass (see ``grouped``). For the others all groups are split and
    written by group and part in one pass, so a group's fit reads only its own
    files. The driver holds the list of groups; ``at_once`` of them are fitted together, in the
    order of their codes or, with a random selection, in a random order of the seed.
    """
    if task.method in grouped.METHODS:
        parts = grouped.group_parts(samples, members, n_experiments, selection, task.seed)
        return grouped.experiments(samples, parts, task, key)
    spark = samples.sparkSession
    members = members_with_samples(members, samples)
    numbered = hardware_numbers(members)
    groups = {r["code"]: r["hwconfig"] for r in numbered.collect()}
    coded = keyed_join(members, numbered, ["hwconfig"])
    rows: list = []
    for i in range(n_experiments):
        split = feat.machine_split(coded, "code", "hostname", "position", selection, task.seed + i)
        parts = split.select(F.col("hostname").alias("host"), "code", "part")
        path = scratch_path(spark, "experiment")
        joined = keyed_join(samples, parts, ["host"])
        rebalanced(joined, "code", "part").write.partitionBy("code", "part").parquet(path)
        stored = spark.read.parquet(path)
        tested = {r["code"] for r in parts.where("part = 'test'").select("code").distinct().collect()}

        def run(code: int, stored=stored, tested=tested, i=i) -> list[tuple]:
            of = lambda part: stored.where(
                (F.col("code") == code) & (F.col("part") == part)
            ).drop("code", "part")
            return run_one(of("train"), of("test") if code in tested else None, task, groups[code], i)[0]

        with ThreadPoolExecutor(max_workers=at_once) as pool:
            order = sorted(groups)
            if selection == "random":
                random.Random(task.seed + i).shuffle(order)
            for found in pool.map(run, order):
                rows += found
    return spark.createDataFrame(rows, RESULT)


def hardware_numbers(members: DataFrame) -> DataFrame:
    """A number per hardware group, by name; groups are far fewer than machines."""
    names = members.select("hwconfig").distinct().orderBy("hwconfig").collect()
    return members.sparkSession.createDataFrame(
        [(r["hwconfig"], i) for i, r in enumerate(names)], "hwconfig string, code int"
    )


def medians(results: DataFrame) -> DataFrame:
    """Median of each figure over the experiments of a group."""
    return evaluate.experiment_medians(
        results.where("status = 'ok'"), ["part", "hwconfig", "metric", "actual", "predicted"], ["value"]
    )


def score_saved(model, samples: DataFrame, task: Task) -> tuple[DataFrame, DataFrame]:
    """Predictions of a saved model on new samples, and their metrics."""
    scored = model.transform(_numbers(test_set(samples, task), task))
    return predictions(scored), metrics(scored, task, len(model.features))
