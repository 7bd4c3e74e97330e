"""Sample encoding, class balancing, machine split and correlation."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rackpulse.functions.status import (
    all_of, bind, cpu_load_class, load_average_class, not_negative, util_label,
)
from rackpulse.operators.ranking import (
    hash_slice, mean_places, rank_in_group, shuffled_order, slice_offsets, value_positions,
)
from rackpulse.operators.skew import keyed_join
from rackpulse.session import materialise

# Features that stay even when their correlation is undefined.
ALWAYS_KEPT = ("power", "cpu_power", "inlet_temp", "util", "load")

# Fixed value: names of readings that count as fans.
FAN_NAMES = "(?i)fan"

# Ranks (rows times columns) that one task sorts.
RANK_ROWS = 1 << 20

LABELS = {"binary": "util", "multi": "load", "reg": "load"}
CLASSES = {"binary": (0, 1), "multi": (0, 1, 2, 3)}


@dataclass(frozen=True)
class EncodeOptions:
    """What to encode: sensor switches, ground truth and label form."""

    overall_power: str | None = "as-is"  # 'as-is' BMC power, 'host' sum of both supplies
    cpu_power: bool = False
    fan_power: bool = False
    hdd_power: bool = False
    systemboard_power: bool = False
    inlet_temp: bool = False
    exhaust_temp: bool = False
    fans: tuple[str, ...] = ()  # names of fan sensors to encode
    cpuload: str = "as-is"  # 'as-is' value or 'class'
    truth: str = "cpuload"  # 'cpuload' or 'loadavg'
    threshold: float = 0.0
    timestamp: bool = True

    def features(self) -> list[str]:
        names = ["overall_power"] if self.overall_power else []
        plain = ("cpu_power", "fan_power", "hdd_power", "systemboard_power", "inlet_temp", "exhaust_temp")
        return names + [n for n in plain if getattr(self, n)] + list(self.fans)


def cpu_power() -> Column:
    """Processor power: its own reading, else the sum of the two sockets."""
    return F.coalesce(F.col("cpu_power"), _extra("CPU1 Power") + _extra("CPU2 Power"))


def _extra(name: str) -> Column:
    return F.try_element_at(F.col("extra"), F.lit(name))


def encode_samples(samples: DataFrame, options: EncodeOptions = EncodeOptions()) -> DataFrame:
    """Features and labels of curated samples, negative readings and incomplete rows dropped.

    A host that never reports its processor power or a fan keeps its rows, with
    that feature empty; every other selected feature must be present.
    """
    truth = F.col("cpuload_total") if options.truth == "cpuload" else F.col("loadavg")
    rules = [truth >= 0, not_negative("power"), not_negative("util")]
    values: dict[str, Column] = {}
    optional: list[str] = list(options.fans)
    if options.overall_power:
        values["overall_power"] = F.col("power" if options.overall_power == "as-is" else "power_px")
    if options.cpu_power:
        values["cpu_power"] = cpu_power()
        optional.append("cpu_power")
        rules += [not_negative("cpu_power"), not_negative(_extra("CPU1 Power")), not_negative(_extra("CPU2 Power"))]
    for name in ("fan_power", "hdd_power", "systemboard_power", "inlet_temp", "exhaust_temp"):
        if getattr(options, name):
            values[name] = F.col(name)
            rules.append(not_negative(name))
    for fan in options.fans:
        values[fan] = _extra(fan)
        rules.append(not_negative(_extra(fan)))
    if options.truth == "loadavg":
        load = load_average_class("loadavg")
    elif options.cpuload == "class":
        load = cpu_load_class("cpuload_total", options.threshold)
    else:
        load = F.col("cpuload_total")
    encoded = samples.where(all_of(rules)).select(
        "host", F.col("bmc_ts").alias("time"),
        *[v.alias(name) for name, v in values.items()],
        util_label("cpuload_total", options.threshold).alias("util"), load.alias("load"),
    )
    complete = complete_rows(encoded, [*values, "util", "load"], optional)
    kept = complete.where((F.col("util") >= 0) & (F.col("load") >= 0))
    return kept if options.timestamp else kept.drop("time")


def complete_rows(df: DataFrame, columns: list[str], optional: list[str], host: str = "host") -> DataFrame:
    """Rows without empty columns; an optional column counts only for hosts that ever fill it."""
    required = [c for c in columns if c not in optional]
    full = df.where(all_of([F.col(f"`{c}`").isNotNull() for c in required]))
    if not optional:
        return full
    flags = [f"_has_{i}" for i in range(len(optional))]
    reported = df.groupBy(host).agg(
        *[F.max(F.col(f"`{c}`").isNotNull()).alias(flag) for c, flag in zip(optional, flags)]
    )
    joined = keyed_join(full, reported, [host])
    return joined.where(
        all_of([F.col(f"`{c}`").isNotNull() | ~F.col(flag) for c, flag in zip(optional, flags)])
    ).drop(*flags)


def in_load_range(load: Column | str, lower: float, upper: float) -> Column:
    """Load within the bounds; the lower one counts only when it is 0."""
    v = F.col(load) if isinstance(load, str) else load
    return (v >= lower if lower == 0.0 else v > lower) & (v <= upper)


def in_feature_range(features: list[str], start: float, end: float) -> Column:
    """Every feature within the plotted range."""
    return all_of([F.col(f"`{c}`").between(start, end) for c in features])


def for_task(df: DataFrame, ctype: str) -> DataFrame:
    """Drops the label the task does not use."""
    return df.drop("load" if ctype == "binary" else "util")


def class_counts(df: DataFrame, by: list[str], threshold: float = 0.0, as_classes: bool = True) -> DataFrame:
    """Samples per binary and load class, zero and non-zero totals."""
    load = F.col("load") if as_classes else cpu_load_class("load", threshold)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("util") == u).alias(f"u{u}") for u in CLASSES["binary"]],
        *[F.count_if(load == c).alias(f"l{c}") for c in CLASSES["multi"]],
    )
    return counts.withColumn("nonzero", F.col("l1") + F.col("l2") + F.col("l3"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def dataset_shape(df: DataFrame, by: str = "host") -> DataFrame:
    """Rows and columns of each host's data set, its host column not counted."""
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.lit(len(df.columns) - 1).alias("n_columns")
    )


def balanced_sample(
    df: DataFrame, label: str, classes: tuple[int, ...], key: Column, seed: int = 0
) -> DataFrame:
    """Every class cut to the size of the smallest, by a reproducible random order.

    Nothing is returned when a class is empty. Slices of the order that fit a
    class's share whole are kept as they are; only the slice the share ends in is sorted.
    The slice table has at most slices times classes rows, so it is written once and broadcast.
    """
    order = shuffled_order(key, seed)
    sliced = df.where(F.col(label).isin(*classes)).withColumn("_order", order).withColumn(
        "_slice", hash_slice(F.col("_order"))
    )
    offsets = materialise(slice_offsets(sliced, [label]), "slices")
    sizes = offsets.groupBy(label).agg(F.sum("_size").alias("_class_size"))
    share = sizes.agg(
        F.when(F.count("*") == len(classes), F.min("_class_size")).otherwise(F.lit(0))
    ).scalar()
    bounds = offsets.withColumn("_share", share).where(F.col("_before") < F.col("_share"))
    placed = sliced.join(F.broadcast(bounds), [label, "_slice"])
    whole = placed.where(F.col("_before") + F.col("_size") <= F.col("_share"))
    edge = placed.where(F.col("_before") + F.col("_size") > F.col("_share"))
    position = F.row_number().over(Window.partitionBy(label).orderBy("_order", key))
    cut = edge.withColumn("_rank", position).where(F.col("_rank") <= F.col("_share") - F.col("_before"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def machine_split(
    members: DataFrame, group: str | list[str], machine: str, position: str, selection: str = "random", seed: int | Column = 0
) -> DataFrame:
    """Half of each hardware group for training, the rest for testing, in random or listed order.

    A group of one is for training only. ``group`` may be several columns and the seed a column that is constant in a group.
    """
    by = [group] if isinstance(group, str) else list(group)
    order = shuffled_order(F.col(position), seed) if selection == "random" else F.col(position)
    ordered = members.withColumn("_order", order)
    slice_of = hash_slice(F.col("_order")) if selection == "random" else F.floor(F.col("_order") / 4096)
    ranked = rank_in_group(ordered, by, slice_of, ["_order", position], "_rank")
    sizes = members.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = keyed_join(ranked, sizes, by)
    train = F.greatest(F.floor(F.col("_n") * 0.5), F.lit(1))
    return joined.withColumn(
        "part", F.when(F.col("_rank") <= train, "train").otherwise("test")
    ).drop("_order", "_rank", "_n")


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns; undefined (null) when one is constant."""
    return F.try_divide(
        F.covar_pop(f"`{a}`", f"`{b}`"), F.stddev_pop(f"`{a}`") * F.stddev_pop(f"`{b}`")
    )


def correlation_with_label(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label, highest first; one pass."""
    row = df.agg(*[pearson(f, label).alias(f) for f in features])
    return row.unpivot([], [f"`{f}`" for f in features], "feature", "corr").orderBy(
        F.desc_nulls_last("corr"), "feature"
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])
    row = df.agg(*[pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def spearman_with_label(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rank correlation of each feature with the label, ties at their mean rank.

    Rows with an empty column are left out. Works on distinct (feature, value,
    label) combinations with their frequency, so repeated values are counted once
    and no column is sorted in one task. They are written once, since several
    later steps read them.
    """
    numbers = df.select(
        F.col(label).cast("double").alias("y"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features]
    ).dropna()
    pairs = materialise(
        numbers.unpivot(["y"], [f"`{f}`" for f in features], "feature", "x")
        .groupBy("feature", "x", "y").agg(F.count("*").alias("n")),
        "rank-pairs",
    )

    def mean_ranks(counts: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
        rank = F.col("before") + (F.col("n") + 1) / 2
        return value_positions(counts, keys, value).select(*keys, value, rank.alias(out), "total")

    x_counts = pairs.groupBy("feature", "x").agg(F.sum("n").alias("n"))
    # Every row is present under each feature, so one feature's pairs give the label's ranks.
    y_counts = pairs.where(F.col("feature") == features[0]).groupBy("y").agg(F.sum("n").alias("n"))
    y_ranks = mean_ranks(y_counts.withColumn("_all", F.lit(0)), ["_all"], "y", "ry").select("y", "ry")
    # Both sides may be large, so the split of a frequent value is left to adaptive execution.
    ranked = pairs.join(mean_ranks(x_counts, ["feature"], "x", "rx"), ["feature", "x"]).join(y_ranks, "y")
    # The mean of all ranks is (N + 1) / 2 with or without ties.
    middle = (F.col("total") + 1) / 2
    dx, dy, n = F.col("rx") - middle, F.col("ry") - middle, F.col("n")
    return ranked.groupBy("feature").agg(
        F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))).alias("corr")
    ).orderBy(F.desc_nulls_last("corr"), "feature")


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of every pair of columns, in long form; rows with an empty column are left out.

    Every column is ranked once, all columns in one global order; a row's ranks come together again by its number, and one aggregation
    gives the products of all pairs.
    """
    numbered = materialise(
        df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna().withColumn("row", F.monotonically_increasing_id()),
        "rank-rows",
    )
    names = [f"c{i}" for i in range(len(columns))]
    long = numbered.unpivot("row", names, "name", "x").withColumn("column", F.substring("name", 2, 9).cast("int")).drop("name")
    total_rows = numbered.count()
    total = F.lit(total_rows)
    # Rows that compress well would be gathered into few large tasks; a task gets as many whatever the table's size.
    tasks = max(1, ceil(total_rows * len(columns) / RANK_ROWS))
    ranked = mean_places(long, "column", "x", "row", "mean", tasks)
    # Places of a column start where the one before it ends; its mean place is in their middle.
    centred = ranked.withColumn("rank", F.col("mean") - F.col("column") * total - (total - 1) / 2)
    aligned = centred.repartition(tasks, "row").groupBy("row").agg(*[F.max(F.when(F.col("column") == i, F.col("rank"))).alias(n) for i, n in enumerate(names)])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = aligned.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i, j in pairs])
    spread = lambda i: F.sqrt(F.col(f"_{i}_{i}"))
    cells = [F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.try_divide(F.col(f"_{i}_{j}"), spread(i) * spread(j)).alias("corr")) for i, j in pairs]
    return sums.select(F.inline(F.array(*cells)))


def _no_readings() -> Column:
    return F.create_map().cast("map<string,double>")


def fan_readings(pattern: str = FAN_NAMES) -> Column:
    """Readings of a curated sample whose name speaks of a fan, whatever the case of its letters."""
    own = F.when(F.col("fan_power").isNotNull(), F.create_map(F.lit("fan_power"), F.col("fan_power"))).otherwise(_no_readings())
    return F.map_filter(F.map_concat(F.coalesce("extra", _no_readings()), own), lambda k, _: k.rlike(pattern))


def fan_dictionary(samples: DataFrame, pattern: str = FAN_NAMES) -> DataFrame:
    """Names of all fan readings that occur, coded by name, with the samples that have them. As many rows as sensors have names.

    The samples are read once, here; the codes are a small written table.
    """
    # The names of a sample are counted as one value first: samples share few sets of names, and only those are taken apart.
    own = F.when(F.col("fan_power").isNotNull(), F.lit("fan_power"))
    sets = samples.select(F.map_keys(F.coalesce("extra", _no_readings())).alias("keys"), own.alias("own")).groupBy("keys", "own").agg(F.count("*").alias("n"))
    all_names = F.array_distinct(F.concat("keys", F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array().cast("array<string>"))))
    names = sets.select("n", F.explode(all_names).alias("name")).where(F.col("name").rlike(pattern)).groupBy("name").agg(F.sum("n").alias("n_samples"))
    coded = names.withColumn("code", (F.row_number().over(Window.orderBy("name")) - 1).cast("bigint"))
    return materialise(coded, "fan-names")


def with_fans(samples: DataFrame, dictionary: DataFrame, pattern: str = FAN_NAMES) -> DataFrame:
    """Samples with their fan readings as a sparse feature: code and value by code (``fans``).

    Nobody names the fans: whatever the dictionary found is taken. Samples with an empty or negative fan reading are dropped.
    """
    codes = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("name", "code")))).scalar()

    def coded(entries: Column) -> Column:
        good = F.forall(entries, lambda e: e["value"].isNotNull() & (e["value"] >= 0))
        fans = F.transform(entries, lambda e: F.struct(F.try_element_at(F.col("_codes"), e["key"]).alias("code"), e["value"].alias("value")))
        return F.when(good, F.array(F.struct(F.sort_array(fans).alias("fans"))))

    # A generator: a filter on the result would be moved before it and read the maps of every sample twice.
    coded_rows = F.inline(bind(F.map_entries(fan_readings(pattern)), coded))
    return samples.withColumn("_codes", codes).select(*samples.columns, coded_rows)


@dataclass(frozen=True)
class TrainingFacts:
    """Size of a training set, spread of its label and the features worth using."""

    n_rows: int
    label_deviation: float
    features: list[str]


def training_facts(df: DataFrame, features: list[str], label: str) -> TrainingFacts:
    """One pass over a training set.

    A feature is used when every row has it and its correlation with the label is
    defined, that is when neither is constant; a few are used even if constant.
    """
    names = [*features, label]
    row = df.agg(
        F.count("*").alias("_n"), F.stddev_pop(f"`{label}`").alias("_sd"),
        *[
            F.struct(F.min(f"`{c}`").alias("low"), F.max(f"`{c}`").alias("high"), F.count(f"`{c}`").alias("n")).alias(c)
            for c in names
        ],
    ).first()
    varies = {c: row[c]["low"] != row[c]["high"] for c in names}
    full = {c: row[c]["n"] == row["_n"] for c in names}
    usable = [f for f in features if full[f] and ((varies[f] and varies[label]) or f in ALWAYS_KEPT)]
    return TrainingFacts(row["_n"], float(row["_sd"] or 0.0), usable)
