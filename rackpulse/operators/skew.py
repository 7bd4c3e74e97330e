"""Joins and last-wins selection that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def keyed_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a large frame to one with few rows per key.

    The plan is left to adaptive execution: a small side is broadcast by its measured size, and where it is not, a
    partition that one key fills is split over as many tasks as its size asks for.
    """
    return big.join(small, on, how)


def last_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key: the last in ``order``.

    Spark applies the rank limit before the shuffle too, so a key with many
    copies sends only one row per task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key in ``order``, limited before the shuffle as well."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= k).drop("_rank")
