"""Confusion matrix, accuracy, one-versus-rest AUC and regression errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows per actual and predicted class: a single pass, all later figures use this."""
    return df.groupBy(
        F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_percent(
    outcomes: DataFrame, classes: tuple[int, ...], absent_as_zero_class: bool = False
) -> DataFrame:
    """Share of each predicted class in percent of the actual class.

    An actual class without rows has no share; ``absent_as_zero_class`` reports it
    as if all its rows had been predicted 0.
    """
    grid = outcomes.sparkSession.createDataFrame(
        [(a, p) for a in classes for p in classes], "actual int, predicted int"
    )
    sizes = outcomes.groupBy("actual").agg(F.sum("n").alias("_total"))
    share = F.coalesce("n", F.lit(0)) * 100.0 / F.col("_total")
    if absent_as_zero_class:
        share = F.coalesce(share, F.when(F.col("predicted") == 0, 100.0).otherwise(0.0))
    return (
        grid.join(outcomes, ["actual", "predicted"], "left").join(sizes, "actual", "left")
        .select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"), share.alias("pct"))
    )


def accuracy(outcomes: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return outcomes.agg((right / F.sum("n")).alias("accuracy"))


def one_vs_rest_auc(outcomes: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    """AUC of hard predictions per actual class: the mean of hit rate and rejection rate.

    A predicted class that never occurs as an actual one counts as a hit for
    every class. With a single actual class the figure is undefined (null).
    """
    actuals = outcomes.select(F.col("actual").alias("predicted"), F.lit(True).alias("_known")).distinct()
    known = outcomes.join(actuals, "predicted", "left")
    n, is_known = F.col("n"), F.coalesce("_known", F.lit(False))
    figures = []
    for c in classes:
        mine, hit = F.col("actual") == c, (F.col("predicted") == c) | ~is_known
        of = lambda cond: F.sum(F.when(cond, n).otherwise(0))
        hit_rate = F.try_divide(of(mine & hit), of(mine))
        rejection = F.try_divide(of(~mine & ~hit), of(~mine))
        figures.append(F.struct(((hit_rate + rejection) / 2).alias("auc"), of(mine).alias("n")).alias(str(c)))
    row = known.agg(*figures)
    return (
        row.unpivot([], [f"`{c}`" for c in classes], "class", "m")
        .where("m.n > 0").select(F.col("class").cast("int").alias("class"), "m.auc")
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, n_features: int) -> DataFrame:
    """Root mean square and mean absolute error, R2 and adjusted R2 in one pass."""
    a, p = F.col(actual), F.col(predicted)
    n = F.count("*")
    sse = F.sum((a - p) * (a - p))
    sst = F.var_pop(a) * n
    r2 = 1 - F.try_divide(sse, sst)
    return df.where(a.isNotNull() & p.isNotNull()).agg(
        n.alias("n"), F.sqrt(sse / n).alias("rmse"), F.avg(F.abs(a - p)).alias("mae"), r2.alias("r2"),
        (1 - F.try_divide((1 - r2) * (n - 1), n - n_features - 1)).alias("adjr2"),
    )


def experiment_medians(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Median of each metric over repeated experiments; one row per experiment, so few rows."""
    return results.groupBy(*keys).agg(*[F.median(m).alias(m) for m in metrics])
