"""Fleet counters, power sums and the point form of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.status import STATUSES, VERDICTS, as_column, status_of, up_code


def _long(df: DataFrame, keys: list[str], names: tuple[str, ...], label: str, values: str) -> DataFrame:
    """Counter columns turned into rows of (label, value)."""
    return df.unpivot(keys, list(names), label, values)


def status_counts(df: DataFrame, value: Column | str, by: list[str] | None = None) -> DataFrame:
    """Machines per status; a status nobody has counts 0."""
    by = by or []
    status = status_of(as_column(value).cast("double"))
    counts = df.groupBy(*by).agg(*[F.count_if(status == s).alias(s) for s in STATUSES])
    return _long(counts, by, STATUSES, "status", "n")


def power_state_rollup(
    df: DataFrame, power_state: str, power: str, by: list[str] | None = None
) -> DataFrame:
    """Machines per power state and the sum of the readings above zero."""
    by = by or []
    code = up_code(power_state)
    return df.groupBy(*by).agg(
        F.count_if(code == -1).alias("unknown"), F.count_if(code == -2).alias("error"),
        F.count_if(code == 0).alias("down"), F.count_if(code == 1).alias("up"),
        F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(F.col(power) > 0, F.col(power))), F.lit(0.0)).alias("pwr_sum"),
    )


def power_state_points(rollup: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = ("unknown", "error", "down", "up", "total", "pwr_sum")
    numbers = rollup.select(*(by or []), *[F.col(n).cast("double").alias(n) for n in names])
    return _long(numbers, by or [], names, "status", "value")


def power_by_status(
    df: DataFrame, load: str, power: str, by: list[str] | None = None
) -> DataFrame:
    """Power of the machines of each load status.

    ``raw_sum`` and ``raw_avg`` add up every reading, codes included, as the fleet
    counters always did; ``clean_sum`` adds the readings above zero.
    """
    by = by or []
    status = status_of(F.col(load).cast("double"))
    aggs = []
    for s in STATUSES:
        mine = F.when(status == s, F.col(power))
        aggs.append(
            F.struct(
                F.coalesce(F.sum(mine), F.lit(0.0)).alias("raw_sum"),
                F.coalesce(F.try_divide(F.sum(mine), F.count_if(status == s)), F.lit(0.0)).alias("raw_avg"),
                F.coalesce(F.sum(F.when(F.col(power) > 0, mine)), F.lit(0.0)).alias("clean_sum"),
                F.count_if(status == s).alias("n"),
            ).alias(s)
        )
    wide = df.groupBy(*by).agg(*aggs)
    return _long(wide, by, STATUSES, "status", "m").select(*by, "status", "m.*")


def verdict_counts(df: DataFrame, verdict: str = "verdict", by: list[str] | None = None) -> DataFrame:
    """Machines per utilisation verdict; an unused verdict counts 0."""
    by = by or []
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(verdict) == v).alias(v) for v in VERDICTS])
    return _long(counts, by, VERDICTS, "verdict", "n")


def verdict_power(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of the machines' mean power, per outcome.

    Machines without a verdict of used or under-used all count as unknown, which
    leaves the sum of switched-off machines at 0.
    """
    by = by or []
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("mean_power"))), F.lit(0.0))
    used, unused = F.col("verdict") == "nonzero", F.col("verdict") == "zero"
    sums = df.groupBy(*by).agg(
        share(F.lit(False)).alias("pwr_off_avg"), share(used).alias("pwr_util_avg"),
        share(unused).alias("pwr_unutil_avg"), share(~used & ~unused).alias("pwr_unknown_avg"),
    )
    names = ("pwr_off_avg", "pwr_util_avg", "pwr_unutil_avg", "pwr_unknown_avg")
    return _long(sums, by, names, "metric", "value")


def host_points(df: DataFrame, host: str, time: str, measurements: list[str]) -> DataFrame:
    """One point per host and measurement of a wide frame."""
    numbers = df.select(host, time, *[F.col(m).cast("double").alias(m) for m in measurements])
    return numbers.unpivot([host, time], measurements, "measurement", "value").select(
        "measurement", F.create_map(F.lit("host"), F.col(host).cast("string")).alias("tags"),
        F.col(time).cast("timestamp").alias("time"), "value",
    )


def counter_points(df: DataFrame, measurement: str, time: str, label: str, value: str) -> DataFrame:
    """Fleet counters as points tagged with their status."""
    return df.select(
        F.lit(measurement).alias("measurement"),
        F.create_map(F.lit("status"), F.col(label)).alias("tags"),
        F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value"),
    )
