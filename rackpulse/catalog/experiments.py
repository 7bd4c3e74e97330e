"""Experiments on the hardware groups of all parts and on given machine lists, held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.features import sql_shuffled
from rackpulse.catalog.inventory import GROUPS
from rackpulse.catalog.tables import SAMPLES, fixed, sql_cpu_class, sql_fixed
from rackpulse.functions.status import cpu_load_class
from rackpulse.models import experiment
from rackpulse.models.estimators import RIDGE_ALPHA
from rackpulse.models.grouped import SMOOTHING
from rackpulse.operators import inventory as inv

REPEATS = 3
DIGITS = 3


def _group_members(spark, d):
    """Every part as a machine, with the code of its hardware configuration."""
    places = t.part_facts(spark, d).select("hostname", "position")
    coded = inv.coded_members(t.curated_parts(spark, d)).withColumn("hwconfig", F.col("code").cast("string"))
    return coded.join(places, "hostname").select("hwconfig", "hostname", "position")


def _part_samples(spark, d):
    """Line items as samples of the machine named by their part."""
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    load = F.col("l_quantity") * 2 - 2 + F.col("l_tax") * 25
    return t.read(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("host"), (81 + F.col("l_extendedprice") / 500).alias("overall_power"),
        (30 + F.col("l_discount") * 50).alias("exhaust_temp"), load.alias("load"), order.alias("place"),
    )


# Coded groups, their machines that have samples, and the samples themselves.
_MEMBERS = f"""{GROUPS}, coded AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS code FROM grp),
smpl AS (SELECT l_partkey AS position, 81 + l_extendedprice / 500 AS x, 30 + l_discount * 50 AS x2, l_quantity * 2 - 2 + l_tax * 25 AS y,
    l_orderkey * 8 + l_linenumber AS place FROM lineitem),
mem AS (SELECT CAST(c.code AS VARCHAR) AS g, k.position FROM keyed k JOIN coded c ON k.system_product = c.system_product AND k.cpu = c.cpu
  AND k.n_cpu = c.n_cpu AND k.cores = c.cores AND k.n_mem = c.n_mem AND k.mem_gb = c.mem_gb
  AND k.gpu IS NOT DISTINCT FROM c.gpu AND k.n_disk = c.n_disk AND k.disk_key = c.disk_key AND k.n_nic = c.n_nic
  WHERE k.position IN (SELECT position FROM smpl))"""


def _sql_parts(order: str, repeats: int) -> str:
    """Half of each group's machines for training, for each experiment."""
    return f"""prt AS (SELECT g, position, i, CASE WHEN rn <= greatest(floor(n * 0.5), 1) THEN 'train' ELSE 'test' END AS part
  FROM (SELECT g, position, i, row_number() OVER (PARTITION BY g, i ORDER BY {order}, position) AS rn, count(*) OVER (PARTITION BY g, i) AS n
    FROM mem, range({repeats}) e(i)) z)"""


def experiments_by_group(spark, d):
    """Least squares in every hardware group: medians over repeated random splits of the group's machines."""
    task = experiment.Task("reg", "lir", ("overall_power",), lower=0.0, upper=80.0)
    results = experiment.by_hardware_group(_part_samples(spark, d), _group_members(spark, d), task, REPEATS, "random")
    found = experiment.medians(results)
    return found.select("part", "hwconfig", "metric", fixed("value", DIGITS).alias("value"))


EXPERIMENTS = f"""
WITH {_MEMBERS}, {_sql_parts(sql_shuffled('position', 0).replace('+ 0)', '+ i)'), REPEATS)},
k AS (SELECT g, i, part, x, y FROM smpl JOIN prt USING (position) WHERE part = 'train' OR (y >= 0 AND y <= 80)),
fit AS (SELECT g, i, avg(x) AS mx, avg(y) AS my, coalesce(regr_slope(y, x), 0) AS b, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN 1 ELSE 0 END AS used
  FROM k WHERE part = 'train' GROUP BY 1, 2),
z AS (SELECT k.g, k.i, part, count(*) AS n, sum((y - my - b * (x - mx)) * (y - my - b * (x - mx))) AS sse, avg(abs(y - my - b * (x - mx))) AS mae,
    var_pop(y) * count(*) AS sst, any_value(used) AS used FROM k JOIN fit ON fit.g = k.g AND fit.i = k.i GROUP BY 1, 2, 3),
w AS (SELECT part, g, 'rmse' AS metric, sqrt(sse / n) AS v FROM z UNION ALL SELECT part, g, 'mae', mae FROM z
  UNION ALL SELECT part, g, 'r2', 1 - sse / nullif(sst, 0) FROM z
  UNION ALL SELECT part, g, 'adjr2', 1 - (sse / nullif(sst, 0)) * (n - 1) / nullif(n - used - 1, 0) FROM z)
SELECT part, g AS hwconfig, metric, {sql_fixed('median(v)', DIGITS)} AS value FROM w GROUP BY 1, 2, 3"""


def experiments_class_by_group(spark, d):
    """Gaussian Bayes for the load class in every hardware group, on classes balanced by group.

    Groups without one of the classes are told as skipped.
    """
    samples = _part_samples(spark, d).withColumn("load", cpu_load_class("load", 4.0).cast("double"))
    task = experiment.Task("multi", "nbc", ("overall_power", "exhaust_temp"))
    results = experiment.by_hardware_group(samples, _group_members(spark, d), task, 1, "linear", key=F.col("place"))
    return results.select("part", "hwconfig", "status", "metric", "actual", "predicted", fixed("value", DIGITS).alias("value"))


EXPERIMENTS_CLASS = f"""
WITH {_MEMBERS}, {_sql_parts('position', 1)},
k AS (SELECT g, part, x, x2, place, {sql_cpu_class('y', 4.0)} AS c FROM smpl JOIN prt USING (position)),
sizes AS (SELECT g, c, count(*) AS n FROM k WHERE part = 'train' GROUP BY 1, 2),
share AS (SELECT g, min(n) AS share FROM sizes GROUP BY 1 HAVING count(*) = 4),
r AS (SELECT k.*, row_number() OVER (PARTITION BY g, c ORDER BY {sql_shuffled('place')}, place) AS rn FROM k WHERE part = 'train'),
s AS (SELECT g, 'train' AS part, x, x2, place, c FROM r JOIN share USING (g) WHERE rn <= share
  UNION ALL SELECT g, part, x, x2, place, c FROM k WHERE part = 'test' AND g IN (SELECT g FROM share)),
f AS (SELECT g, CASE WHEN max(x) > min(x) THEN 1 ELSE 0 END AS u1, CASE WHEN max(x2) > min(x2) THEN 1 ELSE 0 END AS u2,
    greatest(var_pop(x), var_pop(x2)) * {SMOOTHING}::DOUBLE AS e FROM s WHERE part = 'train' GROUP BY 1),
m AS (SELECT g, c, avg(x) AS m1, avg(x2) AS m2, var_pop(x) + any_value(e) AS v1, var_pop(x2) + any_value(e) AS v2,
    any_value(u1) AS u1, any_value(u2) AS u2 FROM s JOIN f USING (g) WHERE part = 'train' GROUP BY 1, 2),
q AS (SELECT s.g, s.part, s.place, s.c AS a, m.c AS p, -(CASE WHEN u1 = 1 THEN ln(v1) + (x - m1) * (x - m1) / v1 ELSE 0 END
    + CASE WHEN u2 = 1 THEN ln(v2) + (x2 - m2) * (x2 - m2) / v2 ELSE 0 END) AS score FROM s JOIN m USING (g)),
b AS (SELECT g, part, a, p FROM (SELECT *, row_number() OVER (PARTITION BY g, part, place ORDER BY score DESC, p) AS rn FROM q) z WHERE rn = 1),
o AS (SELECT g, part, a, p, count(*) AS n FROM b GROUP BY ALL),
act AS (SELECT g, part, a, sum(n) AS n FROM o GROUP BY ALL),
tot AS (SELECT g, part, sum(n) AS n FROM o GROUP BY ALL),
cls AS (SELECT unnest([0, 1, 2, 3]) AS c),
h AS (SELECT o.*, x.g IS NULL AS unknown FROM o LEFT JOIN act x ON x.g = o.g AND x.part = o.part AND x.a = o.p),
auc AS (SELECT h.g, h.part, cls.c, sum(n) FILTER (a = c AND (p = c OR unknown)) AS hits, sum(n) FILTER (a = c) AS mine,
    sum(n) FILTER (a <> c AND NOT (p = c OR unknown)) AS away, sum(n) FILTER (a <> c) AS others FROM h, cls GROUP BY 1, 2, 3),
w AS (SELECT part, g, 'accuracy' AS metric, CAST(NULL AS INT) AS actual, CAST(NULL AS INT) AS predicted, coalesce(sum(o.n) FILTER (a = p), 0) / any_value(tot.n) AS v
    FROM o JOIN tot USING (g, part) GROUP BY 1, 2
  UNION ALL SELECT part, g, 'roc_auc', CAST(c AS INT), NULL, CASE WHEN others > 0 THEN (coalesce(hits, 0) / mine + coalesce(away, 0) / others) / 2 END FROM auc WHERE mine > 0
  UNION ALL SELECT tot.part, tot.g, 'confusion', CAST(y.c AS INT), CAST(z.c AS INT), coalesce(o.n, 0) * 100.0 / act.n
    FROM tot CROSS JOIN cls y CROSS JOIN cls z LEFT JOIN o ON o.g = tot.g AND o.part = tot.part AND o.a = y.c AND o.p = z.c
    LEFT JOIN act ON act.g = tot.g AND act.part = tot.part AND act.a = y.c)
SELECT part, g AS hwconfig, 'ok' AS status, metric, actual, predicted, {sql_fixed('v', DIGITS)} AS value FROM w
UNION ALL SELECT DISTINCT 'train', g, 'skipped', 'accuracy', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE) FROM prt WHERE g NOT IN (SELECT g FROM share)
UNION ALL SELECT DISTINCT 'test', g, 'skipped', 'accuracy', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE) FROM prt
  WHERE part = 'test' AND g IN (SELECT g FROM share) AND NOT EXISTS (SELECT 1 FROM tot WHERE tot.g = prt.g AND tot.part = 'test')"""


def experiments_by_lists(spark, d):
    """Ridge on two features, trained on one list of machines and tested on another within load bounds."""
    samples = t.samples(spark, d).select("host", F.col("power_px").alias("overall_power"), "exhaust_temp", F.col("cpuload_total").alias("load"))
    hosts = t.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("host"), "s_suppkey")
    chosen = lambda rest: hosts.where(F.col("s_suppkey") % 3 == rest)
    task = experiment.Task("reg", "rir", ("overall_power", "exhaust_temp"), lower=10.0, upper=80.0)
    results = experiment.by_machine_lists(samples, chosen(0), chosen(1), task)
    return results.select("part", "experiment", "status", "metric", fixed("value", 5).alias("value"))


EXPERIMENTS_LISTS = f"""
WITH {SAMPLES},
k AS (SELECT CASE CAST(host AS INT) % 3 WHEN 0 THEN 'train' ELSE 'test' END AS part, power_px AS x1, exhaust_temp AS x2, cpuload_total AS y FROM smp
  WHERE CAST(host AS INT) % 3 = 0 OR (CAST(host AS INT) % 3 = 1 AND cpuload_total > 10 AND cpuload_total <= 80)),
s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) + {RIDGE_ALPHA} AS a11, var_pop(x2) * count(*) + {RIDGE_ALPHA} AS a22,
    covar_pop(x1, x2) * count(*) AS a12, covar_pop(x1, y) * count(*) AS b1, covar_pop(x2, y) * count(*) AS b2 FROM k WHERE part = 'train'),
fit AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS w1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS w2 FROM s),
e AS (SELECT part, y, y - my - w1 * (x1 - m1) - w2 * (x2 - m2) AS gap FROM k, fit),
z AS (SELECT part, count(*) AS n, sum(gap * gap) AS sse, avg(abs(gap)) AS mae, var_pop(y) * count(*) AS sst FROM e GROUP BY 1),
w AS (SELECT part, 'rmse' AS metric, sqrt(sse / n) AS v FROM z UNION ALL SELECT part, 'mae', mae FROM z UNION ALL SELECT part, 'r2', 1 - sse / sst FROM z
  UNION ALL SELECT part, 'adjr2', 1 - (sse / sst) * (n - 1) / (n - 3) FROM z)
SELECT part, 0 AS experiment, 'ok' AS status, metric, {sql_fixed('v', 5)} AS value FROM w"""

QUERIES = {
    "experiments_by_group": (experiments_by_group, EXPERIMENTS),
    "experiments_class_by_group": (experiments_class_by_group, EXPERIMENTS_CLASS),
    "experiments_by_lists": (experiments_by_lists, EXPERIMENTS_LISTS),
}
