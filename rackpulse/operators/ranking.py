"""Exact ranks and medians of large groups without one task per group.

A group is cut into ordered slices. Slice sizes give each slice its starting
rank; only rows inside one slice are sorted together. Slices come from a hash
(random order) or from the value itself, so a task that runs again cuts the
same slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rackpulse.session import materialise

SLICES = 1 << 16
HASH_RANGE = 1 << 32


def shuffled_order(key: Column, seed: int | Column = 0) -> Column:
    """Reproducible pseudo-random order of integer keys: a multiplicative hash in [0, 2^32). The seed may be a column."""
    half = F.lit(HASH_RANGE // 2)
    mixed = F.pmod(F.pmod(key.cast("bigint"), half) + F.lit(seed), half)
    return F.pmod(mixed * F.lit(2654435761), F.lit(HASH_RANGE))


def hash_slice(order: Column, slices: int = SLICES) -> Column:
    """Slice of a value spread evenly over the hash range."""
    return F.floor(order / F.lit(HASH_RANGE // slices)).cast("int")


def slice_offsets(
    df: DataFrame, group: list[str], slice_col: str = "_slice", weight: Column | None = None
) -> DataFrame:
    """Size of every slice and the total weight of the slices before it."""
    amount = F.count("*") if weight is None else F.sum(weight)
    sizes = df.groupBy(*group, slice_col).agg(amount.alias("_size"))
    earlier = (
        Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    )
    return sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))


def rank_in_group(
    df: DataFrame, group: list[str], slice_of: Column, order: list[Column | str], out: str
) -> DataFrame:
    """1-based position of each row in its group; ``slice_of`` must rise with ``order``."""
    sliced = df.withColumn("_slice", slice_of)
    offsets = slice_offsets(sliced, group).drop("_size")
    inside = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.join(offsets, [*group, "_slice"])
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_slice", "_before")
    )


def value_slice(value: Column) -> Column:
    """Slice of a number: steps of about 1/4096 of its size on a signed log scale.

    A function of the value alone, so it needs no pass over the data, and outliers
    do not crowd the other values into one slice.
    """
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 4096).cast("int")


#: Distinct values that one slice holds, about.
SLICE_VALUES = 4096


def sliced_values(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds ``_slice``, rising with the value: steps of ``value_slice``, each cut by how many values it has.

    A narrow column fills few steps of the log scale, so a step with many values is cut into parts of equal width
    between its least and greatest one. The table of the steps has a row for each step of a group only.
    """
    stepped = counts.withColumn("_step", value_slice(F.col(value)))
    steps = stepped.groupBy(*group, "_step").agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.ceil(F.count("*") / SLICE_VALUES).alias("_parts")
    )
    width = F.col("_high") - F.col("_low")
    part = F.when(width > 0, F.floor((F.col(value) - F.col("_low")) / width * F.col("_parts"))).otherwise(F.lit(0))
    inside = F.least(part, F.col("_parts") - 1)
    joined = stepped.join(steps, [*group, "_step"])
    return joined.withColumn("_slice", F.col("_step").cast("bigint") * F.lit(1 << 32) + inside).drop("_step", "_low", "_high", "_parts")


def _value_offsets(sliced: DataFrame, group: list[str], weight: str) -> DataFrame:
    return slice_offsets(sliced, group, weight=F.col(weight)).withColumn(
        "total", F.sum("_size").over(Window.partitionBy(*group))
    )


def _place(sliced: DataFrame, offsets: DataFrame, group: list[str], value: str, weight: str) -> DataFrame:
    """Adds ``before`` to the rows of the slices in ``offsets``."""
    inside = (
        Window.partitionBy(*group, "_slice").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.join(offsets.drop("_size"), [*group, "_slice"])
        .withColumn("before", F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.col("_before"))
        .drop("_slice", "_before")
    )


def value_positions(
    counts: DataFrame, group: list[str], value: str = "value", weight: str = "n"
) -> DataFrame:
    """Rows before each distinct value (``before``) and in its group (``total``).

    ``counts`` holds one row per group and distinct value with its frequency, so a
    slice holds each value once however often it occurs.
    """
    sliced = sliced_values(counts, group, value)
    return _place(sliced, _value_offsets(sliced, group, weight), group, value, weight)


def exact_medians(
    counts: DataFrame, group: list[str], value: str = "value", weight: str = "n"
) -> DataFrame:
    """Interpolated median per group from distinct values and their frequencies.

    The slice sizes tell which one or two slices hold the middle; only their values
    are sorted.
    """
    lower, upper = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    sliced = sliced_values(counts, group, value)
    middle = _value_offsets(sliced, group, weight).where(
        (F.col("_before") <= upper) & (lower < F.col("_before") + F.col("_size"))
    )
    placed = _place(sliced, middle, group, value, weight)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col(weight))
    return placed.groupBy(*group).agg(
        ((F.max(F.when(holds(lower), F.col(value))) + F.max(F.when(holds(upper), F.col(value)))) / 2)
        .alias("median")
    )


def placed(df: DataFrame, order: list[str], name: str, ranges: int) -> DataFrame:
    """The rows with their place (from 0) in a global order, and the range they were dealt to (``_part``).

    Rows are dealt to ranges by sampled bounds and sorted there; the written table fixes places, and the counts of the ranges, one
    row for each, tell where a range starts. The last column of the order should tell rows apart, so that a value that
    many rows share is cut into ranges too. The number of ranges is said, since rows that compress well would be gathered into few.
    """
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = materialise(ranged, "ranged").withColumn("_part", F.shiftright("_at", 33))
    starts, total = [], 0
    for part, size in sorted((r["_part"], r["count"]) for r in kept.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += size
    heads = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    inside = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return kept.join(F.broadcast(heads), "_part").withColumn(name, F.col("_start") + inside).drop("_at", "_start")


def mean_places(df: DataFrame, group: str, value: str, row: str, name: str, ranges: int) -> DataFrame:
    """The rows with the mean place of the rows of their group that share their value, in the order of group and value.

    Equal values are found inside each range, so no task sees all rows of a frequent value; the few values at the ends of ranges
    may go on in the next one, and a table of them (two for each range) is told to all.
    """
    ranged = placed(df, [group, value, row], "_place", ranges)
    # Numbers by their place, not structs: aggregates of structs sort all rows of a task first.
    edge = lambda by: [by(c, "_place").alias(f"{by.__name__}_{i}") for i, c in enumerate((group, value))]
    ends = ranged.groupBy("_part").agg(*edge(F.min_by), *edge(F.max_by))
    either = F.array(*[F.struct(F.col(f"{n}_0").alias(group), F.col(f"{n}_1").alias(value)) for n in ("min_by", "max_by")])
    crossing = ends.select(F.inline(either)).distinct()
    wide = ranged.join(F.broadcast(crossing), [group, value]).groupBy(group, value).agg(F.min("_place").alias("_low"), F.max("_place").alias("_high"))
    inside = Window.partitionBy("_part", group, value)
    # The runs are dealt to as many tasks, for the same reason.
    local = ranged.repartition(ranges, "_part", group, value).withColumns({"_first": F.min("_place").over(inside), "_last": F.max("_place").over(inside)})
    both = local.join(F.broadcast(wide), [group, value], "left")
    mean = (F.coalesce("_low", "_first") + F.coalesce("_high", "_last")) / 2
    return both.withColumn(name, mean).drop("_part", "_place", "_first", "_last", "_low", "_high")
