"""Connected components of a table of links, by alternating star contractions.

Every step is a join and an aggregation over the links that are left; hubs are handled by partial aggregation and by
Spark's split of skewed joins. Each round is written, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.tables import written


def _toward_least(links: DataFrame, above_only: bool) -> DataFrame:
    """Links of every node's neighbours to the least node around it (``a`` > ``b``)."""
    both = links if above_only else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least if above_only else least.withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if above_only:  # smaller neighbours, and the node itself, hang on the least of them
        moved = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
    return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) of every node of the links except the roots themselves.

    ``links`` has the columns ``a`` and ``b`` in either order; loops and repeated links change nothing.
    """
    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = written(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = state(now)
    while seen[0]:
        now = written(_toward_least(_toward_least(now, False), True), "links")
        found = state(now)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
