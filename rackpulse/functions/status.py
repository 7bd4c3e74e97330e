"""Sentinel codes, status classes, load classes and the utilisation verdict."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The codes a collector stores instead of a reading.
UNKNOWN, ERROR, OFF = -1, -2, -3

# The five status classes, in reporting order.
STATUSES = ("unknown", "off", "util", "unutil", "error")

# Verdict names, in reporting order.
VERDICTS = ("off", "error", "unknown", "zero", "nonzero")

# The load average above which a machine counts as used.
BUSY_LOAD = 0.03


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once, however often the result uses it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def status_of(value: Column | str) -> Column:
    """Status class of a sentinel-coded value; other negatives have none."""
    v = as_column(value)
    return (
        F.when(v > 0, "util").when(v == 0, "unutil").when(v == UNKNOWN, "unknown")
        .when(v == ERROR, "error").when(v == OFF, "off")
    )


def verdict_of(login: Column | str, load: Column | str, busy_load: float = BUSY_LOAD) -> Column:
    """Verdict from the last login count and the looked-back load; first rule wins."""
    n, load_avg = as_column(login), as_column(load)
    coded = lambda code: (n == code) | (load_avg == code)
    return (
        F.when(coded(OFF), "off").when(coded(ERROR), "error").when(coded(UNKNOWN), "unknown")
        .when((n > 0) | (load_avg > busy_load), "nonzero").otherwise("zero")
    )


def cpu_load_class(load: Column | str, threshold: float = 0.0) -> Column:
    """Four classes of a CPU load in percent; the threshold rule comes first."""
    v = as_column(load)
    return (
        F.when(v.isNull(), None).when(v <= threshold, 0).when(v <= 10, 1).when(v <= 40, 2)
        .when(v > 40, 3)
    )


def load_average_class(load: Column | str) -> Column:
    """Four classes of a load average."""
    v = as_column(load)
    return F.when(v < BUSY_LOAD, 0).when(v <= 10, 1).when(v <= 40, 2).when(v > 40, 3)


def util_label(load: Column | str, threshold: float = 0.0) -> Column:
    """Binary label: 0 up to the threshold, else 1."""
    v = as_column(load)
    return F.when(v <= threshold, 0).when(v > threshold, 1)


def util_flag(load: Column | str) -> Column:
    """Flag a sampler stores beside the CPU load: its sign."""
    return F.signum(as_column(load)).cast("int")


def up_code(power_state: Column | str) -> Column:
    """Numeric power state of a machine."""
    p = as_column(power_state)
    return F.when(p == "error", -1).when(p == "on", 1).when(p == "off", 0).otherwise(-2)


def not_negative(col: Column | str) -> Column:
    """True for a reading that is absent or not negative."""
    return F.coalesce(as_column(col) >= 0, F.lit(True))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
