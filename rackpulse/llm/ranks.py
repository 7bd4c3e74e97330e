"""Places of rows in a global order, without a task that sees more than a range of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.tables import free, written

#: ``monotonically_increasing_id`` holds the partition above this bit and the place in the partition below it.
_PLACE_BITS = 33


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """The rows with their place (from 0) in the order given.

    Rows are dealt to ranges of the order and sorted there; the written table fixes each row's range and its place in
    it, and the counts of the ranges (one small row for each) give the place the range starts at. Rows alike in every
    column of ``order`` stand next to each other in any order; end the order with a column that tells rows apart, so that a
    value many rows share is cut into ranges too. An empty table gives an empty one.
    """
    at, part = free(df, "row_at", "row_part")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    kept = written(ranged, "ranged").withColumn(part, F.shiftright(F.col(at), _PLACE_BITS))
    counts = sorted((r[part], r["count"]) for r in kept.groupBy(part).count().collect())  # a row for each range
    starts, total = [], 0
    for number, size in counts:
        starts.append((number, total))
        total += size
    first, = free(kept, "row_first")
    heads = df.sparkSession.createDataFrame(starts, f"{part} long, {first} long")
    inside = F.col(at) - F.shiftleft(F.col(part), _PLACE_BITS)
    return kept.join(F.broadcast(heads), part).withColumn(name, F.col(first) + inside).select(*df.columns, name)
