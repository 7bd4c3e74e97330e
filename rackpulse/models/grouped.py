"""Experiments of all hardware groups at once, for methods whose fit follows from sums.

Least squares, ridge and Gaussian Bayes need only counts, means, variances and covariances. One aggregation gives
them for every group and experiment, a small solve per group runs where its row lies, the models are joined to the
rows they score, and a second aggregation gives the figures. Neither groups, models nor results visit the driver, and
the number of jobs does not depend on the number of groups.

A feature is used in a group when every training row has it and it varies there (a few stay even if constant). A row that
lacks a used feature has no prediction and counts in no figure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.models.estimators import RIDGE_ALPHA, check_method
from rackpulse.operators import features as feat
from rackpulse.operators.inventory import members_with_samples
from rackpulse.operators.ranking import HASH_RANGE, rank_in_group, shuffled_order
from rackpulse.operators.skew import keyed_join
from rackpulse.session import materialise

METHODS = ("lir", "rir", "nbc")
RESULT = ["part", "hwconfig", "experiment", "status", "metric", "actual", "predicted", "value"]
#: Added to every variance of Gaussian Bayes, as a share of the largest variance of a feature.
SMOOTHING = 1e-9
#: Rows of a class that one ranking task sees, about.
RANKED_TOGETHER = 4096

KEYS = ["hwconfig", "experiment"]


def balanced(rows: DataFrame, keys: list[str], label: str, classes: tuple[int, ...], key: Column, seed: Column) -> DataFrame:
    """Every class of every group cut to the size of the group's smallest, by a reproducible random order.

    A group without one of the classes has no rows. Large classes are cut into slices of the order by their counts, so no task
    sorts a whole class.
    """
    counts = materialise(rows.where(F.col(label).isin(*classes)).groupBy(*keys, label).agg(F.count("*").alias("_n")), "class-sizes")
    share = F.when(F.count("*") == len(classes), F.min("_n")).otherwise(F.lit(0))
    shares = counts.join(counts.groupBy(*keys).agg(share.alias("_share")), keys).where("_share > 0")
    sized = keyed_join(rows, shares, [*keys, label]).withColumn("_order", shuffled_order(key, seed))
    slices = F.ceil(F.col("_n") / RANKED_TOGETHER)
    ranked = rank_in_group(sized, [*keys, label], F.floor(F.col("_order") * slices / HASH_RANGE), ["_order", key], "_rank")
    return ranked.where(F.col("_rank") <= F.col("_share")).select(*rows.columns)


def _values(features: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{f}`").cast("double") for f in features]


def _spread(values: list[Column]) -> list[Column]:
    """Least and greatest value and count of each column."""
    return [F.array(*[of(v) for v in values]).alias(n) for n, of in (("low", F.min), ("high", F.max), ("filled", F.count))]


def _used(features: tuple[str, ...], row, label_varies: bool = True) -> np.ndarray:
    """Features that every row has and that vary, as the figures of a group's row tell."""
    kept = np.array([f in feat.ALWAYS_KEPT for f in features])
    full = np.asarray(row.filled, dtype=np.int64) == row.n
    low, high = (np.array([np.nan if x is None else x for x in v], dtype=float) for v in (row.low, row.high))
    return full & (kept | ((low != high) & label_varies))


def _linear(train: DataFrame, keys: list[str], features: tuple[str, ...], label: str, alpha: float) -> DataFrame:
    """Coefficients of every group: keys, n, n_used, intercept, weights (null for a feature that is not used)."""
    x, y, size = _values(features), F.col(label).cast("double"), len(features)
    sums = train.where(y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(y).alias("y_mean"), F.var_pop(y).alias("y_var"), F.array(*[F.avg(v) for v in x]).alias("means"),
        F.array(*[F.covar_pop(v, y) for v in x]).alias("with_y"),
        F.array(*[F.covar_pop(x[i], x[j]) for i in range(size) for j in range(i, size)]).alias("between"), *_spread(x),
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(size)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                used = _used(features, row, row.y_var > 0)
                square = np.zeros((size, size))
                square[upper] = [0.0 if c is None else c for c in row.between]
                square = (square + np.triu(square, 1).T)[np.ix_(used, used)]
                target = np.array([0.0 if c is None else c for c in row.with_y])[used]
                # The mean square form: the penalty is spread over the rows; without one, the solution of least norm.
                penalty = alpha / row.n * np.eye(len(target))
                if alpha or not len(target):
                    found = np.linalg.solve(square + penalty, target)
                else:
                    found = np.linalg.lstsq(square, target, rcond=1e-12)[0]
                means = np.array([0.0 if m is None else m for m in row.means])[used]
                weights = np.full(size, None, dtype=object)
                weights[used] = found.tolist()
                rows.append((*(getattr(row, k) for k in keys), row.n, int(used.sum()), float(row.y_mean - found @ means), weights.tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "n", "n_used", "intercept", "weights"])

    kinds = ", ".join(f"{k} {t}" for k, t in sums.select(*keys).dtypes)
    return sums.mapInPandas(solve, f"{kinds}, n bigint, n_used int, intercept double, weights array<double>")


def _bayes(train: DataFrame, keys: list[str], features: tuple[str, ...], label: str) -> DataFrame:
    """Gaussian classes of every group: keys, n, n_used, classes (class, constant, means, precisions; null where not used)."""
    x, size = _values(features), len(features)
    sums = train.groupBy(*keys, F.col(label).cast("int").alias("class")).agg(
        F.count("*").alias("n"), F.array(*[F.avg(v) for v in x]).alias("means"), F.array(*[F.var_pop(v) for v in x]).alias("spreads"), *_spread(x)
    )
    parts = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("class", "n", "means", "spreads", "low", "high", "filled"))).alias("classes"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda values: np.array([np.nan if v is None else v for v in values], dtype=float)
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                n = np.array([c["n"] for c in row.classes], dtype=float)
                means, spreads, low, high = (np.stack([number(c[k]) for c in row.classes]) for k in ("means", "spreads", "low", "high"))
                filled = np.sum([list(c["filled"]) for c in row.classes], axis=0)
                kept = np.array([f in feat.ALWAYS_KEPT for f in features])
                used = (filled == n.sum()) & (kept | ((np.nanmin(low, axis=0) != np.nanmax(high, axis=0)) & (len(n) > 1)))
                share = (n / n.sum())[:, None]
                total = (share * (spreads + (means - (share * means).sum(0)) ** 2)).sum(0)
                spreads = spreads + SMOOTHING * (total[used].max() if used.any() else 0.0)
                constant = np.log(n / n.sum()) - 0.5 * np.log(2 * np.pi * spreads[:, used]).sum(1)
                told = []
                for c, k, m, v in zip(row.classes, constant, means, spreads):
                    keep = lambda values: [float(a) if u else None for a, u in zip(values, used)]  # noqa: E731, B023
                    told.append({"class": int(c["class"]), "constant": float(k), "means": keep(m), "precisions": keep(1 / np.where(used, v, 1.0))})
                rows.append((*(getattr(row, k) for k in keys), int(n.sum()), int(used.sum()), told))
            yield pd.DataFrame(rows, columns=[*keys, "n", "n_used", "classes"])

    kinds = ", ".join(f"{k} {t}" for k, t in parts.select(*keys).dtypes)
    shape = "array<struct<class:int,constant:double,means:array<double>,precisions:array<double>>>"
    return parts.mapInPandas(solve, f"{kinds}, n bigint, n_used int, classes {shape}")


def fit(train: DataFrame, keys: list[str], method: str, features: tuple[str, ...], label: str) -> DataFrame:
    """One model per group, as a row; groups without training rows have none."""
    if method == "nbc":
        return _bayes(train, keys, features, label)
    return _linear(train, keys, features, label, RIDGE_ALPHA if method == "rir" else 0.0)


def predict(rows: DataFrame, models: DataFrame, keys: list[str], method: str, features: tuple[str, ...]) -> DataFrame:
    """Rows of groups that have a model, with ``prediction`` and ``n_used``."""
    x = F.array(*_values(features))
    joined = keyed_join(rows, models.drop("n"), keys)
    if method == "nbc":
        def score(c: Column) -> Column:
            apart = F.zip_with(x, c["means"], lambda v, m: (v - m) * (v - m))
            weighed = F.zip_with(apart, c["precisions"], lambda a, p: F.when(p.isNull(), F.lit(0.0)).otherwise(a * p))
            return c["constant"] - F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b) / 2

        best = F.array_max(F.transform("classes", lambda c: F.struct(score(c).alias("s"), (-c["class"]).alias("c"))))
        prediction = F.when(best["s"].isNotNull(), (-best["c"]).cast("double"))
        return joined.withColumn("prediction", prediction).drop("classes")
    parts = F.zip_with("weights", x, lambda w, v: F.when(w.isNull(), F.lit(0.0)).otherwise(w * v))
    prediction = F.col("intercept") + F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn("prediction", prediction).drop("weights", "intercept")


def _figure(metric: str, value: Column, actual: int | None = None, predicted: int | None = None) -> Column:
    return F.struct(
        F.lit(metric).alias("metric"), F.lit(actual).cast("int").alias("actual"), F.lit(predicted).cast("int").alias("predicted"),
        value.cast("double").alias("value"),
    )


def _regression_figures(scored: DataFrame, by: list[str], label: str) -> DataFrame:
    gap = F.col(label) - F.col("prediction")
    n, sst = F.col("n"), F.col("spread") * F.col("n")
    sums = scored.where(gap.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(gap * gap).alias("sse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop(label).alias("spread"), F.max("n_used").alias("n_used")
    )
    r2 = 1 - F.try_divide(F.col("sse"), sst)
    adjusted = 1 - F.try_divide((1 - r2) * (n - 1), n - F.col("n_used") - 1)
    figures = [_figure("rmse", F.sqrt(F.col("sse") / n)), _figure("mae", F.col("mae")), _figure("r2", r2), _figure("adjr2", adjusted)]
    return sums.select(*by, F.inline(F.array(*figures)))


def _class_figures(scored: DataFrame, by: list[str], label: str, classes: tuple[int, ...]) -> DataFrame:
    """Accuracy, one-versus-rest AUC of hard predictions and confusion shares from one count for each pair of classes.

    A predicted class that never occurs as an actual one counts as a hit for every class.
    """
    cell = {(a, p): F.col(f"n_{a}_{p}") for a in classes for p in classes}
    counts = scored.where(F.col("prediction").isNotNull()).groupBy(*by).agg(
        *[F.count_if((F.col(label) == a) & (F.col("prediction") == p)).alias(f"n_{a}_{p}") for a, p in cell]
    )
    size = {a: sum((cell[a, p] for p in classes), F.lit(0)) for a in classes}
    total = sum(size.values(), F.lit(0))
    hits = lambda a, c: sum((F.when((size[p] == 0) | F.lit(p == c), cell[a, p]).otherwise(0) for p in classes), F.lit(0))
    figures = [_figure("accuracy", F.try_divide(sum((cell[a, a] for a in classes), F.lit(0)), total))]
    for c in classes:
        others = [a for a in classes if a != c]
        rejected = sum((size[a] - hits(a, c) for a in others), F.lit(0))
        auc = (F.try_divide(hits(c, c), size[c]) + F.try_divide(rejected, total - size[c])) / 2
        figures.append(F.when(size[c] > 0, _figure("roc_auc", auc, c)))
    figures += [_figure("confusion", F.try_divide(n * 100.0, size[a]), a, p) for (a, p), n in cell.items()]
    return counts.select(*by, F.inline(F.filter(F.array(*figures), lambda f: f.isNotNull())))


def experiments(samples: DataFrame, parts: DataFrame, task, key: Column | None = None, test_source: DataFrame | None = None) -> DataFrame:
    """Results of all groups and experiments (columns ``RESULT``).

    ``parts`` has hwconfig, host, experiment and part ('train' or 'test'); a group may be null. ``key`` orders the rows of a class
    when classes are balanced, by default a hash of the row. Test rows come from ``test_source`` where given.
    A group with an empty class or without training rows, and a test part without rows, has one row marked skipped.
    """
    check_method(task.ctype, task.method)
    if task.method not in METHODS:
        raise ValueError(f"method {task.method} has no fit from sums; choose one of {METHODS}")
    label = task.label
    # A group of its own stands for the null group while rows are joined and counted.
    group = F.coalesce(F.concat(F.lit("="), "hwconfig"), F.lit("")).alias("hwconfig")
    # Written once: training rows, test rows and the list of what to expect all start from the split.
    named = materialise(parts.select(group, "host", F.col("experiment").cast("int").alias("experiment"), "part"), "experiment-parts")
    needed = list(dict.fromkeys([*task.features, label, "load"]))
    of = lambda df: df.select("host", *[f"`{c}`" for c in needed], (F.xxhash64(*[f"`{c}`" for c in df.columns]) if key is None else key).alias("_key"))
    placed = lambda df, part: keyed_join(of(df), named.where(F.col("part") == part), ["host"]).withColumn(label, F.col(label).cast("double"))
    train = placed(samples, "train")
    if task.ctype != "reg":
        train = balanced(train, KEYS, label, feat.CLASSES[task.ctype], F.col("_key"), F.col("experiment") + task.seed)
    test = placed(samples if test_source is None else test_source, "test").where(feat.in_load_range("load", task.lower, task.upper))
    rows = materialise(train.unionByName(test).drop("host", "_key"), "experiment-rows")

    models = materialise(fit(rows.where("part = 'train'"), KEYS, task.method, task.features, label), "experiment-models")
    scored = predict(rows, models, KEYS, task.method, task.features)
    by = [*KEYS, "part"]
    figures = _regression_figures(scored, by, label) if task.ctype == "reg" else _class_figures(scored, by, label, feat.CLASSES[task.ctype])
    # A group without a model is skipped as a whole; a test part without figures on its own.
    expected = named.groupBy(*by).agg(F.count("*").alias("_hosts")).join(models.select(*KEYS, F.lit(True).alias("_fitted")), KEYS, "left")
    expected = expected.where((F.col("part") == "train") | F.col("_fitted"))
    joined = expected.join(figures, by, "left")
    skipped = F.col("metric").isNull()
    return joined.select(
        "part", F.when(F.col("hwconfig") != "", F.expr("substring(hwconfig, 2)")).alias("hwconfig"), "experiment",
        F.when(skipped, "skipped").otherwise("ok").alias("status"), F.when(skipped, "accuracy").otherwise(F.col("metric")).alias("metric"),
        "actual", "predicted", "value",
    )


def group_parts(samples: DataFrame, members: DataFrame, n_experiments: int, selection: str, seed: int) -> DataFrame:
    """Half of each group's machines that have samples for training, the rest for testing, anew for each experiment."""
    seen = members_with_samples(members.select("hwconfig", "hostname", "position"), samples)
    repeated = seen.withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(n_experiments - 1))))
    split = feat.machine_split(repeated, KEYS, "hostname", "position", selection, F.col("experiment") + seed)
    return split.select("hwconfig", F.col("hostname").alias("host"), "experiment", "part")


def list_parts(train_hosts: DataFrame, test_hosts: DataFrame | None, n_experiments: int) -> DataFrame:
    """Given machines as one group without a name."""
    part = lambda df, name: df.select("host").distinct().withColumn("part", F.lit(name))
    both = part(train_hosts, "train") if test_hosts is None else part(train_hosts, "train").unionByName(part(test_hosts, "test"))
    numbered = both.withColumn("experiment", F.explode(F.sequence(F.lit(0), F.lit(n_experiments - 1))))
    return numbered.select(F.lit(None).cast("string").alias("hwconfig"), "host", "experiment", "part")
