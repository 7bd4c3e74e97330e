"""Sample encoding, classes, balancing, splits, correlation and load-bin profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.tables import (
    SAMPLES, fixed, sql_cpu_class, sql_fixed, sql_loadavg_class,
)
from rackpulse.functions.parse import micros
from rackpulse.functions.status import cpu_load_class, load_average_class, util_label
from rackpulse.operators import features as feat
from rackpulse.operators import profile
from rackpulse.operators.features import EncodeOptions
from rackpulse.operators.ranking import exact_medians
from rackpulse.operators.series import sensors_with_truth

THRESHOLD = 4.0
FULL = EncodeOptions(
    cpu_power=True, inlet_temp=True, fans=("Fan1",), cpuload="class", threshold=THRESHOLD
)


def _encoded(spark, d, options=FULL):
    return feat.encode_samples(t.samples(spark, d), options)


# Hosts that never report processor power or fan keep their rows.
ENCODED = f"""{SAMPLES}, valid AS (
  SELECT host, bmc_ts, power AS overall_power, cpu_power, inlet_temp, fan1, cpuload_total,
    CASE WHEN cpuload_total <= {THRESHOLD} THEN 0 ELSE 1 END AS util,
    {sql_cpu_class('cpuload_total', THRESHOLD)} AS load
  FROM smp WHERE cpuload_total >= 0 AND power >= 0 AND inlet_temp >= 0 AND coalesce(cpu_power, 0) >= 0),
has AS (SELECT host, bool_or(cpu_power IS NOT NULL) AS has_cpu, bool_or(fan1 IS NOT NULL) AS has_fan FROM valid GROUP BY 1),
enc AS (
  SELECT valid.* FROM valid JOIN has USING (host)
  WHERE (cpu_power IS NOT NULL OR NOT has_cpu) AND (fan1 IS NOT NULL OR NOT has_fan))"""


def encoded_samples(spark, d):
    """Encoded rows, summed per host, day and label to compare them as a set."""
    rows = _encoded(spark, d)
    return rows.groupBy("host", micros("time").alias("time_us"), "util", "load").agg(
        F.count("*").alias("n"), fixed(F.sum("overall_power"), 3).alias("overall_power"),
        fixed(F.sum("cpu_power"), 3).alias("cpu_power"), fixed(F.sum("inlet_temp"), 3).alias("inlet_temp"),
        fixed(F.sum("Fan1"), 3).alias("fan1"),
    )


ENCODED_SAMPLES = f"""
WITH {ENCODED}
SELECT host, epoch_us(bmc_ts) AS time_us, util, load, count(*) AS n, {sql_fixed('sum(overall_power)', 3)} AS overall_power,
  {sql_fixed('sum(cpu_power)', 3)} AS cpu_power, {sql_fixed('sum(inlet_temp)', 3)} AS inlet_temp,
  {sql_fixed('sum(fan1)', 3)} AS fan1 FROM enc GROUP BY ALL"""


def host_power_samples(spark, d):
    """Power summed from the host's supplies, load average as truth, all board sensors."""
    options = EncodeOptions(
        overall_power="host", fan_power=True, hdd_power=True, systemboard_power=True, exhaust_temp=True, truth="loadavg"
    )
    return _encoded(spark, d, options).groupBy("host", "load").agg(
        F.count("*").alias("n"), fixed(F.sum("overall_power"), 2).alias("power"),
        fixed(F.sum(F.col("fan_power") + F.col("hdd_power") + F.col("systemboard_power")), 2).alias("board"),
        fixed(F.sum("exhaust_temp"), 2).alias("exhaust"), F.sum("util").alias("n_used"),
    )


HOST_POWER = f"""
WITH {SAMPLES}
SELECT host, {sql_loadavg_class('loadavg')} AS load, count(*) AS n, {sql_fixed('sum(power_px)', 2)} AS power,
  {sql_fixed('count(*) * 46.0', 2)} AS board, {sql_fixed('sum(exhaust_temp)', 2)} AS exhaust,
  CAST(count(*) FILTER (cpuload_total > 0) AS BIGINT) AS n_used
FROM smp WHERE loadavg >= 0 AND power >= 0 GROUP BY 1, 2"""


def load_classes(spark, d):
    rows = t.samples(spark, d)
    return rows.groupBy(
        cpu_load_class("cpuload_total", THRESHOLD).alias("cpu_class"),
        cpu_load_class("cpuload_total", 15.0).alias("high_threshold_class"),
        load_average_class("loadavg").alias("load_class"), util_label("cpuload_total", THRESHOLD).alias("util"),
    ).agg(F.count("*").alias("n"))


LOAD_CLASSES = f"""
WITH {SAMPLES}
SELECT {sql_cpu_class('cpuload_total', THRESHOLD)} AS cpu_class, {sql_cpu_class('cpuload_total', 15.0)} AS high_threshold_class,
  {sql_loadavg_class('loadavg')} AS load_class, CASE WHEN cpuload_total <= {THRESHOLD} THEN 0 ELSE 1 END AS util,
  count(*) AS n FROM smp GROUP BY 1, 2, 3, 4"""


def class_counts(spark, d):
    return feat.class_counts(_encoded(spark, d), ["host"])


CLASS_COUNTS = f"""
WITH {ENCODED}
SELECT host, count(*) AS n, count(*) FILTER (util = 0) AS u0, count(*) FILTER (util = 1) AS u1,
  count(*) FILTER (load = 0) AS l0, count(*) FILTER (load = 1) AS l1, count(*) FILTER (load = 2) AS l2,
  count(*) FILTER (load = 3) AS l3, count(*) FILTER (load > 0) AS nonzero FROM enc GROUP BY 1"""


def label_counts(spark, d):
    return feat.label_counts(_encoded(spark, d), "load")


def dataset_shape(spark, d):
    return feat.dataset_shape(_encoded(spark, d))


def sensor_truth_join(spark, d):
    """Sensor rows joined to their labels on host and time, from two tables that share part of their keys."""
    sensors = t.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("host"), F.col("l_linenumber").cast("bigint").alias("time"),
        (F.col("l_extendedprice") / 1000).alias("overall_power"),
    )
    truth = t.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("host"), (F.col("o_custkey") % 7 + 1).alias("time"),
        cpu_load_class(F.col("o_totalprice") / 5000, 12.0).alias("load"),
    )
    joined = sensors_with_truth(sensors, truth)
    return joined.select("host", "time", fixed("overall_power").alias("overall_power"), "load")


SENSOR_TRUTH = f"""
SELECT o_orderkey AS host, l_linenumber::BIGINT AS time, {sql_fixed('l_extendedprice / 1000')} AS overall_power,
  {sql_cpu_class('o_totalprice / 5000', 12.0)} AS load
FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1"""


def load_range(spark, d):
    rows = _encoded(spark, d, EncodeOptions(inlet_temp=True))
    inner = rows.where(feat.in_load_range("load", 10.0, 60.0) & feat.in_feature_range(["overall_power", "inlet_temp"], 18.5, 200.0))
    zero = rows.where(feat.in_load_range("load", 0.0, 40.0))
    count = lambda df, name: df.groupBy("host").agg(F.lit(name).alias("bounds"), F.count("*").alias("n"))
    return count(inner, "inner").unionByName(count(zero, "from zero"))


LOAD_RANGE = f"""
WITH {SAMPLES}, v AS (SELECT * FROM smp WHERE power >= 0 AND inlet_temp >= 0)
SELECT host, 'inner' AS bounds, count(*) AS n FROM v WHERE cpuload_total > 10 AND cpuload_total <= 60
  AND power BETWEEN 18.5 AND 200 AND inlet_temp BETWEEN 18.5 AND 200 GROUP BY 1
UNION ALL SELECT host, 'from zero', count(*) FROM v WHERE cpuload_total >= 0 AND cpuload_total <= 40 GROUP BY 1"""


def _orders(spark, d):
    """Orders as labelled samples; the total price gives the load."""
    load = F.col("o_totalprice") / 5000
    return t.read(spark, d, "orders").select(
        "o_orderkey", cpu_load_class(load, 5.0).alias("load"), util_label(load, 20.0).alias("util")
    )


def balanced_sample_multi(spark, d):
    return feat.balanced_sample(_orders(spark, d), "load", (0, 1, 2, 3), F.col("o_orderkey")).select("o_orderkey", "load")


def balanced_sample_binary(spark, d):
    return feat.balanced_sample(_orders(spark, d), "util", (0, 1), F.col("o_orderkey"), seed=7).select("o_orderkey", "util")


def sql_shuffled(key: str, seed: int = 0) -> str:
    return f"((({key} % 2147483648 + {seed}) % 2147483648) * 2654435761 % 4294967296)"


def _sql_balanced(label: str, rule: str, seed: int) -> str:
    return f"""
WITH s AS (SELECT o_orderkey, {rule} AS {label} FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {sql_shuffled('o_orderkey', seed)}, o_orderkey) AS rn FROM s)
SELECT o_orderkey, {label} FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM s GROUP BY {label}) c)"""


def _members(spark, d):
    return t.read(spark, d, "customer").select(
        F.col("c_mktsegment").alias("hwconfig"), F.col("c_name").alias("hostname"), F.col("c_custkey").alias("position")
    )


def machine_split_random(spark, d):
    return feat.machine_split(_members(spark, d), "hwconfig", "hostname", "position", "random", 11)


def machine_split_listed(spark, d):
    return feat.machine_split(_members(spark, d), "hwconfig", "hostname", "position", "linear")


def _sql_split(order: str) -> str:
    return f"""
SELECT hwconfig, hostname, position, CASE WHEN rn <= greatest(floor(n * 0.5), 1) THEN 'train' ELSE 'test' END AS part
FROM (SELECT c_mktsegment AS hwconfig, c_name AS hostname, c_custkey AS position,
    row_number() OVER (PARTITION BY c_mktsegment ORDER BY {order}, c_custkey) AS rn,
    count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) x"""


_NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "flat"]


def _lines(spark, d):
    return t.read(spark, d, "lineitem").withColumn("flat", F.lit(1.0))


def correlation_rank(spark, d):
    ranked = feat.correlation_with_label(_lines(spark, d), _NUMBERS, "l_extendedprice")
    return ranked.select("feature", fixed("corr", 6).alias("corr"))


def _sql_corr(a: str, b: str) -> str:
    return sql_fixed(f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END", 6)


CORRELATION = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_sql_corr(c, 'l_extendedprice')} AS corr FROM lineitem" for c in _NUMBERS if c != "flat"
) + " UNION ALL SELECT 'flat', CAST(NULL AS DOUBLE)"


def correlation_matrix(spark, d):
    cells = feat.correlation_matrix(_lines(spark, d), ["l_quantity", "l_extendedprice", "l_tax"])
    return cells.select("a", "b", fixed("corr", 6).alias("corr"))


_PAIRS = [("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"),
          ("l_extendedprice", "l_extendedprice"), ("l_extendedprice", "l_tax"), ("l_tax", "l_tax")]
MATRIX = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {_sql_corr(a, b)} AS corr FROM lineitem" for a, b in _PAIRS
)


def spearman_rank(spark, d):
    ranked = feat.spearman_with_label(
        _lines(spark, d), ["l_quantity", "l_discount", "l_linenumber", "flat"], "l_extendedprice"
    )
    return ranked.select("feature", fixed("corr", 6).alias("corr"))


def _sql_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"


SPEARMAN = f"""
WITH r AS (SELECT {_sql_rank('l_quantity')} AS q, {_sql_rank('l_discount')} AS dc, {_sql_rank('l_linenumber')} AS ln,
  {_sql_rank('l_extendedprice')} AS y FROM lineitem)
SELECT 'l_quantity' AS feature, {_sql_corr('q', 'y')} AS corr FROM r
UNION ALL SELECT 'l_discount', {_sql_corr('dc', 'y')} FROM r
UNION ALL SELECT 'l_linenumber', {_sql_corr('ln', 'y')} FROM r
UNION ALL SELECT 'flat', CAST(NULL AS DOUBLE)"""


RANKED = ("l_quantity", "l_discount", "l_linenumber", "l_extendedprice", "l_tax", "flat")


def spearman_matrix(spark, d):
    """Rank correlation of all pairs of six columns, one of them constant."""
    rows = t.read(spark, d, "lineitem").withColumn("flat", F.lit(1.0))
    return feat.spearman_matrix(rows, list(RANKED)).select("a", "b", fixed("corr", 6).alias("corr"))


_RANKS = ", ".join(f"{_sql_rank(c)} AS {c}" for c in RANKED[:-1])
SPEARMAN_MATRIX = f"WITH r AS (SELECT {_RANKS} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("CAST(NULL AS DOUBLE)" if "flat" in (a, b) else _sql_corr(a, b)) + " AS corr" + ("" if "flat" in (a, b) else " FROM r")
    for i, a in enumerate(RANKED) for b in RANKED[i:]
)


def _fan_samples(spark, d):
    """Line items as samples with fans of several names, some of them failing, beside other sensors."""
    qty, line = F.col("l_quantity"), F.col("l_linenumber")
    name = F.concat(F.lit("FAN"), (F.col("l_suppkey") % 3).cast("string"), F.lit(" SYS"))
    extra = F.map_concat(
        F.create_map(name, 3000 + qty), F.create_map(F.lit("CPU1 Power"), qty),
        F.when(line > 3, F.create_map(F.lit("Chassis fan"), F.when(F.col("l_orderkey") % 89 == 1, -1.0).otherwise(1500.0 + line))).otherwise(F.create_map().cast("map<string,double>")),
    )
    return t.read(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("host"), F.when(F.col("l_suppkey") % 2 == 0, 12.0).alias("fan_power"), extra.alias("extra"),
    )


def fan_features(spark, d):
    """All fan readings, found by their names, summed by host, name and code."""
    samples = _fan_samples(spark, d)
    codes = feat.fan_dictionary(samples)
    rows = feat.with_fans(samples, codes).select("host", F.inline("fans"))
    sums = rows.groupBy("host", "code").agg(F.count("*").alias("n"), fixed(F.sum("value"), 3).alias("total"))
    return sums.join(codes.select("code", "name"), "code").select("host", "code", "name", "n", "total")


FAN_FEATURES = f"""
WITH s AS (SELECT row_number() OVER () AS i, l_suppkey, CAST(l_suppkey AS VARCHAR) AS host, l_quantity AS qty, l_linenumber AS line, l_orderkey AS o FROM lineitem),
f AS (SELECT i, host, o, line, 'FAN' || (l_suppkey % 3) || ' SYS' AS name, 3000 + qty AS v FROM s
  UNION ALL SELECT i, host, o, line, 'Chassis fan', CASE WHEN o % 89 = 1 THEN -1 ELSE 1500 + line END FROM s WHERE line > 3
  UNION ALL SELECT i, host, o, line, 'fan_power', 12 FROM s WHERE l_suppkey % 2 = 0),
c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS code FROM (SELECT DISTINCT name FROM f) z)
SELECT host, code, name, count(*) AS n, {sql_fixed('sum(v)', 3)} AS total FROM f JOIN c USING (name)
WHERE NOT (line > 3 AND o % 89 = 1) GROUP BY 1, 2, 3"""


def usable_features(spark, d):
    """Features left after those without a defined correlation go; some always stay."""
    rows = _lines(spark, d).withColumn("inlet_temp", F.lit(20.0))
    facts = feat.training_facts(rows, ["l_quantity", "l_tax", "flat", "inlet_temp"], "l_extendedprice")
    return spark.createDataFrame([(n,) for n in facts.features], "feature string")


USABLE = """
SELECT f AS feature FROM (SELECT 'l_quantity' AS f, min(l_quantity) < max(l_quantity) AS keep FROM lineitem
  UNION ALL SELECT 'l_tax', min(l_tax) < max(l_tax) FROM lineitem
  UNION ALL SELECT 'flat', false UNION ALL SELECT 'inlet_temp', true) x WHERE keep"""


def load_bin_profile(spark, d):
    rows = profile.analysable(t.samples(spark, d))
    bins = profile.load_bin_profile(rows, "load", ["power", "cpu_power"])
    return bins.select(
        "metric", "bin", "n", *[fixed(c).alias(c) for c in ("min", "max", "median", "stddev")]
    )


_BIN = ("CASE WHEN cpuload_total <= 20 THEN 0 WHEN cpuload_total <= 40 THEN 1 WHEN cpuload_total <= 60 THEN 2 "
        "WHEN cpuload_total <= 80 THEN 3 WHEN cpuload_total <= 100 THEN 4 END")
LOAD_BINS = f"""
WITH {SAMPLES}, v AS (
  SELECT {_BIN} AS bin, power, cpu_power FROM smp WHERE cpuload_total >= 0 AND power >= 0 AND util >= 0
    AND inlet_temp >= 0 AND coalesce(cpu_power, 0) >= 0),
l AS (SELECT 'power' AS metric, bin, power AS x FROM v UNION ALL SELECT 'cpu_power', bin, cpu_power FROM v),
g AS (SELECT * FROM (VALUES ('power'), ('cpu_power')) a(metric), (VALUES (0), (1), (2), (3), (4)) b(bin))
SELECT g.metric, g.bin, count(x) AS n, {sql_fixed('min(x)')} AS min, {sql_fixed('max(x)')} AS max,
  {sql_fixed('median(x)')} AS median, {sql_fixed('stddev_samp(x)')} AS stddev
FROM g LEFT JOIN l ON l.metric = g.metric AND l.bin = g.bin GROUP BY 1, 2"""


def narrow_medians(spark, d):
    """Exact medians of a column whose values lie within a thousandth of each other."""
    near = F.round(F.lit(200.0) + F.col("l_extendedprice") / 1_000_000, 8)
    rows = t.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), near.alias("value"))
    counts = rows.groupBy("flag", "value").agg(F.count("*").alias("n"))
    return exact_medians(counts, ["flag"]).select("flag", fixed("median", 8).alias("median"))


NARROW_MEDIANS = f"""
SELECT l_returnflag AS flag, {sql_fixed('median(round(200.0::DOUBLE + l_extendedprice / 1000000, 8))', 8)} AS median
FROM lineitem GROUP BY 1"""

QUERIES = {
    "narrow_medians": (narrow_medians, NARROW_MEDIANS),
    "encoded_samples": (encoded_samples, ENCODED_SAMPLES),
    "host_power_samples": (host_power_samples, HOST_POWER),
    "load_classes": (load_classes, LOAD_CLASSES),
    "class_counts": (class_counts, CLASS_COUNTS),
    "label_counts": (label_counts, f"WITH {ENCODED} SELECT load, count(*) AS n FROM enc GROUP BY 1"),
    "dataset_shape": (
        dataset_shape,
        f"WITH {ENCODED} SELECT host, count(*) AS n_rows, CAST(7 AS INT) AS n_columns FROM enc GROUP BY 1",
    ),
    "sensor_truth_join": (sensor_truth_join, SENSOR_TRUTH),
    "load_range": (load_range, LOAD_RANGE),
    "balanced_sample_multi": (
        balanced_sample_multi, _sql_balanced("load", sql_cpu_class("o_totalprice / 5000", 5.0), 0)
    ),
    "balanced_sample_binary": (
        balanced_sample_binary, _sql_balanced("util", "CASE WHEN o_totalprice / 5000 <= 20 THEN 0 ELSE 1 END", 7)
    ),
    "machine_split_random": (machine_split_random, _sql_split(sql_shuffled("c_custkey", 11))),
    "machine_split_listed": (machine_split_listed, _sql_split("c_custkey")),
    "correlation_rank": (correlation_rank, CORRELATION),
    "correlation_matrix": (correlation_matrix, MATRIX),
    "spearman_rank": (spearman_rank, SPEARMAN),
    "spearman_matrix": (spearman_matrix, SPEARMAN_MATRIX),
    "fan_features": (fan_features, FAN_FEATURES),
    "usable_features": (usable_features, USABLE),
    "load_bin_profile": (load_bin_profile, LOAD_BINS),
}
