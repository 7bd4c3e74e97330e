"""Status roll-ups, look-backs, verdicts, alerts and machine selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.tables import MACHINES, MEASURES, POLLED, STATUS_LIST, USERS, fixed, sql_fixed, sql_status
from rackpulse.functions.parse import micros
from rackpulse.functions.status import VERDICTS, up_code
from rackpulse.operators import inventory as inv
from rackpulse.operators import lookback, rollup
from rackpulse.plans import temperature, utilisation
from rackpulse.sinks.tables import redacted
from rackpulse.sources.dimensions import PRODUCT_TEMPERATURES, product_temperatures
from rackpulse.sources.readings import ups_points

BASE_URL = "http://fleet.example.org"

# -- status and power counters ---------------------------------------------------


def status_counts(spark, d):
    coded = t.measures(spark, d).where(F.col("metric").isin("login_count", "load_avg"))
    return rollup.status_counts(coded, "value", ["metric"])


STATUS_COUNTS = f"""
WITH {MEASURES}, mt(metric) AS (VALUES ('login_count'), ('load_avg'))
SELECT mt.metric, st.status, count(m.event_id) AS n
FROM mt CROSS JOIN {STATUS_LIST}
LEFT JOIN m ON m.metric = mt.metric AND {sql_status('m.value')} = st.status
GROUP BY 1, 2"""


def power_state_rollup(spark, d):
    row = rollup.power_state_rollup(t.polled(spark, d), "power_state", "power")
    return row.withColumn("pwr_sum", fixed("pwr_sum", 2))


POWER_STATE = f"""
WITH {POLLED}
SELECT count(*) FILTER (power_state = 'error') AS unknown, count(*) FILTER (power_state = 'testing') AS error,
  count(*) FILTER (power_state = 'off') AS down, count(*) FILTER (power_state = 'on') AS up, count(*) AS total,
  {sql_fixed('coalesce(sum(power) FILTER (power > 0), 0)', 2)} AS pwr_sum
FROM polled"""


def power_by_load_status(spark, d):
    rows = rollup.power_by_status(t.polled(spark, d), "load_avg", "power")
    return rows.select("status", "n", *[fixed(c, 2).alias(c) for c in ("raw_sum", "raw_avg", "clean_sum")])


POWER_BY_STATUS = f"""
WITH {POLLED}
SELECT st.status, count(p.hostname) AS n, {sql_fixed('coalesce(sum(p.power), 0)', 2)} AS raw_sum,
  {sql_fixed('coalesce(avg(p.power), 0)', 2)} AS raw_avg,
  {sql_fixed('coalesce(sum(p.power) FILTER (p.power > 0), 0)', 2)} AS clean_sum
FROM {STATUS_LIST} LEFT JOIN polled p ON {sql_status('p.load_avg')} = st.status GROUP BY 1"""


def power_state_points(spark, d):
    rolled = rollup.power_state_rollup(t.polled(spark, d), "power_state", "power")
    points = rollup.counter_points(
        rollup.power_state_points(rolled).withColumn("time", F.lit("2024-02-01 00:00:00")),
        "machine_status_count", "time", "status", "value",
    )
    return points.select("measurement", F.col("tags")["status"].alias("status"), fixed("value", 2).alias("value"))


POWER_STATE_POINTS = f"""
WITH {POLLED}, r AS (SELECT power_state, power FROM polled)
SELECT 'machine_status_count' AS measurement, status, {sql_fixed('v', 2)} AS value FROM (
  SELECT 'unknown' AS status, CAST(count(*) FILTER (power_state = 'error') AS DOUBLE) AS v FROM r
  UNION ALL SELECT 'error', count(*) FILTER (power_state = 'testing') FROM r
  UNION ALL SELECT 'down', count(*) FILTER (power_state = 'off') FROM r
  UNION ALL SELECT 'up', count(*) FILTER (power_state = 'on') FROM r
  UNION ALL SELECT 'total', count(*) FROM r
  UNION ALL SELECT 'pwr_sum', coalesce(sum(power) FILTER (power > 0), 0) FROM r)"""


def host_points(spark, d):
    polled = t.polled(spark, d).select(
        "hostname", F.lit("2024-02-01 00:00:00").alias("time"), "load_avg", F.col("power").alias("pwr_consumption"),
        up_code("power_state").alias("up_status"),
    )
    points = rollup.host_points(polled, "hostname", "time", ["load_avg", "pwr_consumption", "up_status"])
    return points.select(
        "measurement", F.col("tags")["host"].alias("host"), micros("time").alias("time_us"), fixed("value").alias("value")
    )


HOST_POINTS = f"""
WITH {POLLED}
SELECT measurement, host, epoch_us(TIMESTAMP '2024-02-01 00:00:00') AS time_us, {sql_fixed('v')} AS value FROM (
  SELECT 'load_avg' AS measurement, hostname AS host, load_avg AS v FROM polled
  UNION ALL SELECT 'pwr_consumption', hostname, power FROM polled
  UNION ALL SELECT 'up_status', hostname, CAST(CASE power_state WHEN 'error' THEN -1 WHEN 'on' THEN 1
    WHEN 'off' THEN 0 ELSE -2 END AS DOUBLE) FROM polled)"""

# -- latest and look-back --------------------------------------------------------


def latest_measure(spark, d):
    return lookback.latest_measures(t.measures(spark, d)).select(
        "host", "metric", fixed("value").alias("value"), micros("ts").alias("ts_us"), "n"
    )


LATEST = f"""
WITH {MEASURES}
SELECT host, metric, {sql_fixed('arg_max(value, ts)')} AS value, epoch_us(max(ts)) AS ts_us, count(*) AS n
FROM m GROUP BY host, metric HAVING metric <> 'login_count' OR count(*) >= 2"""


def latest_temperatures(spark, d):
    rows = temperature.latest_temperatures(t.measures(spark, d))
    return rows.select("host", fixed("inlet_temp").alias("inlet_temp"), fixed("exhaust_temp").alias("exhaust_temp"))


LATEST_TEMPERATURES = f"""
WITH {MEASURES}
SELECT host, {sql_fixed("arg_max(value, ts) FILTER (metric = 'Inlet Temp')")} AS inlet_temp,
  {sql_fixed("arg_max(value, ts) FILTER (metric = 'Exhaust Temp')")} AS exhaust_temp
FROM m WHERE metric IN ('Inlet Temp', 'Exhaust Temp') GROUP BY host"""


def lookback_load(spark, d):
    return lookback.lookbacks(t.measures(spark, d)).select(
        "host", micros("anchor").alias("anchor_us"), "login_count", fixed("load_avg").alias("load_avg")
    )


def lookback_power(spark, d):
    return lookback.lookbacks(t.measures(spark, d)).select("host", fixed("mean_power").alias("mean_power"))


LOOKBACKS = f"""{MEASURES},
anc AS (
  SELECT host, arg_max(value, ts) AS login_count, max(ts) AS anchor FROM m WHERE metric = 'login_count'
  GROUP BY host HAVING count(*) >= 2
),
old AS (
  SELECT host, metric, ts, value FROM (
    SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts DESC) AS rn FROM m) x WHERE rn > 1
),
day AS (
  SELECT anc.host, old.metric, old.ts, old.value FROM anc JOIN old ON old.host = anc.host
  WHERE old.ts < anc.anchor AND old.ts > anc.anchor - INTERVAL 1 DAY
),
lb AS (
  SELECT anc.host, anc.anchor, anc.login_count,
    coalesce(arg_max(day.value, day.ts) FILTER (day.metric = 'load_avg' AND day.value > 0),
      max(CASE WHEN day.metric = 'load_avg' AND day.value = 0 THEN 0.0::DOUBLE END), -1.0::DOUBLE) AS load_avg,
    avg(day.value) FILTER (day.metric = 'Pwr Consumption' AND day.value > 0) AS mean_power
  FROM anc LEFT JOIN day ON day.host = anc.host GROUP BY 1, 2, 3
)"""

VERDICT = f"""{LOOKBACKS}, {MACHINES},
vd AS (
  SELECT lb.*, mach.owner, mach.system_id,
    CASE WHEN login_count = -3 OR load_avg = -3 THEN 'off' WHEN login_count = -2 OR load_avg = -2 THEN 'error'
      WHEN login_count = -1 OR load_avg = -1 THEN 'unknown'
      WHEN login_count > 0 OR load_avg > 0.03 THEN 'nonzero' ELSE 'zero' END AS verdict
  FROM lb JOIN mach ON mach.hostname = lb.host WHERE mach.owner IS NOT NULL
)"""


def _verdicts(spark, d):
    return utilisation.machine_verdicts(t.machines(spark, d), t.measures(spark, d))


def utilisation_verdict(spark, d):
    return _verdicts(spark, d).select(
        "host", "owner", "login_count", fixed("load_avg").alias("load_avg"), fixed("mean_power").alias("mean_power"),
        "verdict",
    )


def verdict_counts(spark, d):
    return rollup.verdict_counts(_verdicts(spark, d))


def verdict_power(spark, d):
    return rollup.verdict_power(_verdicts(spark, d)).select("metric", fixed("value", 3).alias("value"))


VERDICT_POWER = """
  SELECT 'pwr_off_avg' AS metric, 0.0::DOUBLE AS value
  UNION ALL SELECT 'pwr_util_avg', coalesce(sum(mean_power) FILTER (verdict = 'nonzero'), 0) FROM vd
  UNION ALL SELECT 'pwr_unutil_avg', coalesce(sum(mean_power) FILTER (verdict = 'zero'), 0) FROM vd
  UNION ALL SELECT 'pwr_unknown_avg',
    coalesce(sum(mean_power) FILTER (verdict NOT IN ('zero', 'nonzero')), 0) FROM vd"""

_VERDICT_ROWS = ", ".join(f"('{v}')" for v in VERDICTS)
VERDICT_COUNTS = f"""
  SELECT v.verdict, count(vd.host) AS n FROM (VALUES {_VERDICT_ROWS}) v(verdict)
  LEFT JOIN vd ON vd.verdict = v.verdict GROUP BY 1"""


def verdict_points(spark, d):
    points = utilisation.counter_measures(_verdicts(spark, d))
    return points.select(
        "measurement", F.col("tags")["status"].alias("metric"), micros("time").alias("time_us"),
        fixed("value", 3).alias("value"),
    )


VERDICT_POINTS = f"""
WITH {VERDICT}
SELECT 'total_machines' AS measurement, metric, (SELECT epoch_us(max(anchor)) FROM vd) AS time_us,
  {sql_fixed('value', 3)} AS value
FROM (SELECT 'util_' || verdict || '_count' AS metric, CAST(n AS DOUBLE) AS value FROM ({VERDICT_COUNTS})
  UNION ALL {VERDICT_POWER})"""


def under_utilisation_alerts(spark, d):
    found = utilisation.alerts(_verdicts(spark, d), t.users(spark, d), BASE_URL)
    return found.withColumn("links", F.array_join("links", " | "))


def _sql_links() -> str:
    url = f"'{BASE_URL}/MAAS/#/machine/' || system_id"
    return f"'Off ' || {url} || ' | Release ' || {url} || ' | On ' || {url}"


UNDER_UTILISED = f"""
WITH {VERDICT}, {USERS}
SELECT owner, email, 'Under utilization alert' AS subject, host, 'under-utilised' AS reason, {_sql_links()} AS links
FROM vd JOIN usr ON usr.username = vd.owner WHERE verdict = 'zero'"""


def machines_per_owner(spark, d):
    return utilisation.machines_per_owner(t.machines(spark, d))


def unsafe_temp_alerts(spark, d):
    unsafe = temperature.unsafe_machines(t.machines(spark, d), t.measures(spark, d), product_temperatures(spark))
    return temperature.alerts(unsafe, t.users(spark, d), BASE_URL).withColumn("links", F.array_join("links", " | "))


_LIMITS = ", ".join(f"('{p}', {hi})" for p, (_, hi) in PRODUCT_TEMPERATURES.items())
UNSAFE_TEMP = f"""
WITH {MEASURES}, {MACHINES}, {USERS}, lim(product, mx) AS (VALUES {_LIMITS}),
lt AS (
  SELECT host, arg_max(value, ts) FILTER (metric = 'Inlet Temp') AS inlet,
    arg_max(value, ts) FILTER (metric = 'Exhaust Temp') AS exhaust
  FROM m WHERE metric IN ('Inlet Temp', 'Exhaust Temp') GROUP BY host)
SELECT owner, email, 'Unsafe operating temperature alert' AS subject, host, 'unsafe temperature' AS reason,
  {_sql_links()} AS links
FROM mach JOIN lt ON lt.host = mach.hostname JOIN usr ON usr.username = mach.owner
LEFT JOIN lim ON lim.product = mach.product
WHERE power_state = 'on' AND (inlet > 21 OR exhaust > mx)"""

# -- machine selection -----------------------------------------------------------


def eligible_inventory(spark, d):
    return inv.inventory_machines(t.machines(spark, d)).select("hostname", "status_name")


def _skipped(spark, d):
    """Skip list: hosts named like a supplier with a low balance."""
    return t.read(spark, d, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").cast("string").alias("hostname"))


def eligible_telemetry(spark, d):
    kept = inv.telemetry_machines(t.machines(spark, d), _skipped(spark, d), ["Deployed"])
    return kept.select("hostname", "status_name", inv.first_address().alias("ip_address"))


ELIGIBLE_TELEMETRY = f"""
WITH {MACHINES}
SELECT hostname, status_name, first_ip AS ip_address FROM mach
WHERE NOT is_virtual AND status_name <> 'New' AND first_ip IS NOT NULL AND status_name IN ('Deployed')
  AND hostname NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 2000)"""


def skip_list_anti(spark, d):
    return inv.without(t.machines(spark, d), _skipped(spark, d)).select("hostname")


def subset_semi(spark, d):
    return inv.only(t.machines(spark, d), _skipped(spark, d)).select("hostname")


def union_override(spark, d):
    managed = t.machines(spark, d).select("hostname", "power_state", F.lit(None).cast("string").alias("ip_address"))
    unmanaged = t.read(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("hostname"), F.lit("on").alias("power_state"),
        F.col("s_name").alias("ip_address"),
    )
    return inv.override_with(managed, unmanaged)


UNION_OVERRIDE = f"""
WITH {MACHINES}
SELECT hostname, power_state, CAST(NULL AS VARCHAR) AS ip_address FROM mach
WHERE hostname NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'on', s_name FROM supplier"""


def _parameters(spark, d):
    """Power parameters of the hosts named like a supplier; some miss the address."""
    return t.read(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("hostname"), F.lit("admin").alias("power_user"),
        F.col("s_name").alias("power_pass"), F.lit("LAN_2_0").alias("power_driver"),
        F.when(F.col("s_nationkey") > 3, F.lit("172.31.1.1")).alias("power_address"),
    )


def access_codes(spark, d):
    machines = inv.with_power_parameters(t.machines(spark, d), _parameters(spark, d)).withColumn(
        "user", F.when(F.col("position") % 5 == 1, "bot")
    )
    return machines.select(
        "hostname", inv.inband_access().alias("inband_code"),
        inv.bmc_access(["power_user", "power_driver", "power_address"]).alias("bmc_code"),
        up_code("power_state").alias("up"),
    )


ACCESS_CODES = f"""
WITH {MACHINES}
SELECT hostname, CASE WHEN power_state = 'off' THEN -3 WHEN power_state <> 'on' THEN -1
    WHEN position % 5 <> 1 THEN -1 END AS inband_code,
  CASE WHEN power_state = 'error' OR s_nationkey IS NULL OR s_nationkey <= 3 THEN -1 END AS bmc_code,
  CASE power_state WHEN 'error' THEN -1 WHEN 'on' THEN 1 WHEN 'off' THEN 0 ELSE -2 END AS up
FROM mach LEFT JOIN supplier ON s_suppkey = position"""


def description_parse(spark, d):
    from rackpulse.functions.parse import description_field

    return t.machines(spark, d).select(
        "hostname", *[description_field("description", k).alias(k) for k in ("user", "rack", "unit")],
        F.contains("description", F.lit(inv.SERVICE_ACCOUNT)).alias("inband"), inv.first_address().alias("ip_address"),
    )


DESCRIPTION = f"""
WITH {MACHINES}
SELECT hostname, note_user AS "user", note_rack AS rack, note_unit AS unit,
  coalesce(note_user = 'cse_bot', false) AS inband, first_ip AS ip_address FROM mach"""


def redacted_dump(spark, d):
    return redacted(_parameters(spark, d))


REDACTED = """
SELECT CAST(s_suppkey AS VARCHAR) AS hostname, 'admin' AS power_user, 'xxxx' AS power_pass, 'LAN_2_0' AS power_driver,
  CASE WHEN s_nationkey > 3 THEN '172.31.1.1' END AS power_address FROM supplier"""


def ups_readings(spark, d):
    """Events as UPS readings: the event type picks the object id, the number its phase."""
    branch = (
        F.when(F.col("event_type") == "click", "SNMPv2-SMI::enterprises.318.1.1.1.9.3.3.1.4.1.1.")
        .when(F.col("event_type") == "view", "1.3.6.1.4.1.318.1.1.1.9.2.3.1.3.1.1.")
        .when(F.col("event_type") == "purchase", "1.3.6.1.4.1.318.1.1.1.9.3.3.1.10.1.1.")
        .otherwise("1.3.6.1.4.1.999.1.")
    )
    raw = t.read(spark, d, "events").select(
        F.lit("ups3").alias("ups"), F.concat(branch, (F.col("event_id") % 3 + 1).cast("string")).alias("oid"),
        F.col("ts").alias("time"), F.col("value").cast("string").alias("raw"),
    )
    points = ups_points(raw)
    return points.select(
        "measurement", F.col("tags")["io"].alias("io"), F.col("tags")["phase"].alias("phase"),
        micros("time").alias("time_us"), fixed("value", 5).alias("value"),
    )


UPS = f"""
SELECT CASE event_type WHEN 'click' THEN 'current' WHEN 'view' THEN 'voltage' ELSE 'percentload' END AS measurement,
  CASE event_type WHEN 'view' THEN 'input' ELSE 'output' END AS io, 'phase' || (event_id % 3 + 1) AS phase,
  epoch_us(ts) AS time_us, {sql_fixed("CASE event_type WHEN 'click' THEN value / 10 ELSE value END", 5)} AS value
FROM events WHERE event_type IN ('click', 'view', 'purchase')"""

QUERIES = {
    "status_counts": (status_counts, STATUS_COUNTS),
    "power_state_rollup": (power_state_rollup, POWER_STATE),
    "power_by_load_status": (power_by_load_status, POWER_BY_STATUS),
    "power_state_points": (power_state_points, POWER_STATE_POINTS),
    "host_points": (host_points, HOST_POINTS),
    "latest_measure": (latest_measure, LATEST),
    "latest_temperatures": (latest_temperatures, LATEST_TEMPERATURES),
    "lookback_load": (
        lookback_load,
        f"WITH {LOOKBACKS} SELECT host, epoch_us(anchor) AS anchor_us, login_count, {sql_fixed('load_avg')} AS load_avg FROM lb",
    ),
    "lookback_power": (
        lookback_power, f"WITH {LOOKBACKS} SELECT host, {sql_fixed('mean_power')} AS mean_power FROM lb"
    ),
    "utilisation_verdict": (
        utilisation_verdict,
        f"WITH {VERDICT} SELECT host, owner, login_count, {sql_fixed('load_avg')} AS load_avg, "
        f"{sql_fixed('mean_power')} AS mean_power, verdict FROM vd",
    ),
    "verdict_counts": (verdict_counts, f"WITH {VERDICT} {VERDICT_COUNTS}"),
    "verdict_power": (
        verdict_power, f"WITH {VERDICT} SELECT metric, {sql_fixed('value', 3)} AS value FROM ({VERDICT_POWER})"
    ),
    "verdict_points": (verdict_points, VERDICT_POINTS),
    "under_utilisation_alerts": (under_utilisation_alerts, UNDER_UTILISED),
    "machines_per_owner": (
        machines_per_owner,
        f"WITH {MACHINES} SELECT owner, count(*) AS n_machines FROM mach WHERE owner IS NOT NULL GROUP BY 1",
    ),
    "unsafe_temp_alerts": (unsafe_temp_alerts, UNSAFE_TEMP),
    "eligible_inventory": (
        eligible_inventory,
        f"WITH {MACHINES} SELECT hostname, status_name FROM mach WHERE NOT is_virtual "
        "AND status_name NOT IN ('New', 'Failed commissioning', 'Commissioning')",
    ),
    "eligible_telemetry": (eligible_telemetry, ELIGIBLE_TELEMETRY),
    "skip_list_anti": (
        skip_list_anti,
        f"WITH {MACHINES} SELECT hostname FROM mach WHERE hostname NOT IN "
        "(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 2000)",
    ),
    "subset_semi": (
        subset_semi,
        f"WITH {MACHINES} SELECT hostname FROM mach WHERE hostname IN "
        "(SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 2000)",
    ),
    "union_override": (union_override, UNION_OVERRIDE),
    "access_codes": (access_codes, ACCESS_CODES),
    "description_parse": (description_parse, DESCRIPTION),
    "redacted_dump": (redacted_dump, REDACTED),
    "ups_readings": (ups_readings, UPS),
}
