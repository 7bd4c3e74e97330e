"""The given tables seen as fleet data, in Spark and as SQL common table expressions.

The tables hold no telemetry, so columns of machines, readings and hardware are
derived from theirs. Both forms use the same rules over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse import session
from rackpulse.functions.status import bind
from rackpulse.sources.dimensions import PRODUCT_TEMPERATURES

PRODUCTS = [*PRODUCT_TEMPERATURES, "Unlisted product"]
# Machines made by one task; as many have some hundred thousand values and some ten megabytes of details.
MACHINES_PER_TASK = 20_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    session.prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fixed(col: Column | str, digits: int = 4) -> Column:
    """Number cut to fixed digits the same way in both engines; exact halves go up."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 10**digits + 0.50001) / 10**digits


def sql_fixed(expr: str, digits: int = 4) -> str:
    return f"floor(({expr}) * {10**digits} + 0.50001) / {10**digits}"


# -- measures from events ------------------------------------------------------

def measures(spark: SparkSession, folder: str) -> DataFrame:
    """Events as measures. Some event numbers carry a sentinel code instead of a value."""
    kind, n = F.col("event_type"), F.col("event_id")
    metric = (
        F.when(kind == "signup", "login_count").when(kind.isin("click", "view"), "load_avg")
        .when(kind == "purchase", "Pwr Consumption").when(n % 2 == 0, "Inlet Temp").otherwise("Exhaust Temp")
    )
    v = F.col("value")
    reading = (
        F.when(F.col("metric") == "login_count", F.floor(v / 60).cast("double"))
        .when(F.col("metric") == "load_avg", F.when(v < 25, 0.02).otherwise(v / 10))
        .when(F.col("metric") == "Inlet Temp", 17 + v / 10).when(F.col("metric") == "Exhaust Temp", 25 + v / 5)
        .otherwise(v)
    )
    code = F.when(n % 50 == 0, -3.0).when(n % 50 == 1, -2.0).when(n % 50 == 2, -1.0).when(n % 50 == 3, 0.0)
    return read(spark, folder, "events").withColumn("metric", metric).select(
        "event_id", F.col("user_id").cast("string").alias("host"), "metric",
        F.col("ts").cast("timestamp").alias("ts"), F.lit(300.0).alias("granularity"),
        F.coalesce(code, reading).alias("value"),
    )


MEASURES = """
m AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS host, metric, ts,
    CASE event_id % 50 WHEN 0 THEN -3.0::DOUBLE WHEN 1 THEN -2.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE
      WHEN 3 THEN 0.0::DOUBLE
      ELSE CASE metric WHEN 'login_count' THEN floor(value / 60)
        WHEN 'load_avg' THEN CASE WHEN value < 25 THEN 0.02::DOUBLE ELSE value / 10 END
        WHEN 'Inlet Temp' THEN 17 + value / 10 WHEN 'Exhaust Temp' THEN 25 + value / 5 ELSE value END
    END AS value
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'login_count' WHEN 'click' THEN 'load_avg'
          WHEN 'view' THEN 'load_avg' WHEN 'purchase' THEN 'Pwr Consumption'
          ELSE CASE WHEN event_id % 2 = 0 THEN 'Inlet Temp' ELSE 'Exhaust Temp' END END AS metric
        FROM events) e
)"""

# -- machines from customer, owners from nation ----------------------------------


def machines(spark: SparkSession, folder: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    text = key.cast("string")
    state = (
        F.when(key % 11 == 0, "New").when(key % 11 == 1, "Failed commissioning")
        .when(key % 11 == 2, "Commissioning").when(key % 11 == 3, "Ready").otherwise("Deployed")
    )
    power = F.when(key % 6 == 0, "off").when(key % 6 == 1, "error").when(key % 6 == 2, "testing").otherwise("on")
    none = F.array().cast("array<string>")
    note = (
        F.when(key % 5 == 0, "")
        .when(key % 5 == 1, F.concat(F.lit("user:bot;rack:r"), nation, F.lit(";unit:7;note")))
        .when(key % 5 == 2, F.concat(F.lit("rack:a;rack:b"), (key % 9).cast("string"), F.lit(";user:x:y")))
        .when(key % 5 == 3, F.concat(F.lit("user:cse_bot;unit:"), (key % 40).cast("string")))
        .otherwise("free text")
    )
    products = F.array(*[F.lit(p) for p in PRODUCTS])
    return read(spark, folder, "customer").select(
        text.alias("hostname"), key.alias("position"), F.concat(F.lit("s"), text).alias("system_id"),
        F.when(key % 7 != 0, F.concat(F.lit("user"), nation)).alias("owner"),
        F.struct(F.col("c_mktsegment").alias("name")).alias("pool"), state.alias("status_name"),
        power.alias("power_state"),
        F.when(key % 13 == 0, F.array(F.lit("virtual"))).otherwise(none).alias("tag_names"),
        F.when(key % 17 == 0, none).otherwise(F.array(
            F.concat(F.lit("10.0."), nation, F.lit("."), (key % 250).cast("string")), F.lit("192.168.0.1")
        )).alias("ip_addresses"),
        note.alias("description"),
        F.struct(products[(key % len(PRODUCTS)).cast("int")].alias("system_product")).alias("hardware_info"),
        F.concat(F.lit("/m/s"), text).alias("resource_uri"),
    )


_PRODUCT_LIST = "[" + ", ".join(f"'{p}'" for p in PRODUCTS) + "]"

MACHINES = f"""
mach AS (
  SELECT CAST(c_custkey AS VARCHAR) AS hostname, c_custkey AS position, 's' || c_custkey AS system_id,
    CASE WHEN c_custkey % 7 <> 0 THEN 'user' || c_nationkey END AS owner, c_mktsegment AS pool,
    CASE c_custkey % 11 WHEN 0 THEN 'New' WHEN 1 THEN 'Failed commissioning' WHEN 2 THEN 'Commissioning'
      WHEN 3 THEN 'Ready' ELSE 'Deployed' END AS status_name,
    CASE c_custkey % 6 WHEN 0 THEN 'off' WHEN 1 THEN 'error' WHEN 2 THEN 'testing' ELSE 'on' END AS power_state,
    c_custkey % 13 = 0 AS is_virtual,
    CASE WHEN c_custkey % 17 <> 0 THEN '10.0.' || c_nationkey || '.' || (c_custkey % 250) END AS first_ip,
    CASE c_custkey % 5 WHEN 1 THEN 'bot' WHEN 3 THEN 'cse_bot' END AS note_user,
    CASE c_custkey % 5 WHEN 1 THEN 'r' || c_nationkey WHEN 2 THEN 'b' || (c_custkey % 9) END AS note_rack,
    CASE c_custkey % 5 WHEN 1 THEN '7' WHEN 3 THEN CAST(c_custkey % 40 AS VARCHAR) END AS note_unit,
    ({_PRODUCT_LIST})[CAST(c_custkey % {len(PRODUCTS)} AS INT) + 1] AS product
  FROM customer
)"""


def users(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "nation").select(
        F.concat(F.lit("user"), F.col("n_nationkey").cast("string")).alias("username"),
        F.concat(F.lower("n_name"), F.lit("@example.org")).alias("email"),
    )


USERS = """
usr AS (SELECT 'user' || n_nationkey AS username, lower(n_name) || '@example.org' AS email FROM nation)"""


def polled(spark: SparkSession, folder: str) -> DataFrame:
    """Machines with their last load average and power; unknown where never read."""
    newest = lambda metric: F.coalesce(
        F.max_by("value", F.when(F.col("metric") == metric, F.struct("ts", "value"))), F.lit(-1.0)
    )
    last = measures(spark, folder).where(F.col("metric").isin("load_avg", "Pwr Consumption")).groupBy("host").agg(
        newest("load_avg").alias("load_avg"), newest("Pwr Consumption").alias("power")
    )
    return (
        machines(spark, folder).join(last, F.col("hostname") == F.col("host"), "left").drop("host")
        .fillna(-1.0, ["load_avg", "power"])
    )


POLLED = f"""{MEASURES}, {MACHINES},
polled AS (
  SELECT mach.*, coalesce(l.load_avg, -1.0) AS load_avg, coalesce(l.power, -1.0) AS power
  FROM mach LEFT JOIN (
    SELECT host, arg_max(value, ts) FILTER (WHERE metric = 'load_avg') AS load_avg,
      arg_max(value, ts) FILTER (WHERE metric = 'Pwr Consumption') AS power
    FROM m GROUP BY host) l ON l.host = mach.hostname
)"""

# The five status classes, and the class of a value, in SQL.
STATUS_LIST = "(VALUES ('unknown'), ('off'), ('util'), ('unutil'), ('error')) st(status)"


def sql_status(value: str) -> str:
    return (
        f"CASE WHEN {value} > 0 THEN 'util' WHEN {value} = 0 THEN 'unutil' WHEN {value} = -1 THEN 'unknown' "
        f"WHEN {value} = -2 THEN 'error' WHEN {value} = -3 THEN 'off' END"
    )


# -- curated samples from lineitem -----------------------------------------------

def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as curated samples of one host per supplier.

    Every fourth host has no processor power sensor; some readings are codes or absent.
    """
    order, line, qty = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    power = 80 + F.col("l_extendedprice") / 500
    load = qty * 2 - 2 + F.col("l_tax") * 25
    cpu = F.when(F.col("l_suppkey") % 4 == 0, None).when((line == 7) & (order % 3 == 0), None).otherwise(power * 0.4)
    return read(spark, folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("host"), F.lit("production").alias("wtype"),
        F.col("l_shipdate").cast("timestamp").alias("bmc_ts"),
        F.when(order % 97 == 0, -2.0).otherwise(power).alias("power"),
        (power + 1).alias("power_px"), F.signum(load).alias("util"), load.alias("cpuload_total"),
        (qty - 1).alias("loadavg"),
        F.when(order % 89 == 1, -1.0).otherwise(18 + F.col("l_discount") * 50).alias("inlet_temp"),
        (30 + F.col("l_discount") * 50).alias("exhaust_temp"), cpu.alias("cpu_power"),
        F.lit(12.0).alias("fan_power"), F.lit(9.0).alias("hdd_power"), F.lit(25.0).alias("systemboard_power"),
        F.when(F.col("l_suppkey") % 2 == 0, F.create_map(F.lit("Fan1"), 3000 + qty))
        .otherwise(F.create_map().cast("map<string,double>")).alias("extra"),
    )


SAMPLES = """
smp AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS host, l_shipdate AS bmc_ts,
    CASE WHEN l_orderkey % 97 = 0 THEN -2.0::DOUBLE ELSE 80 + l_extendedprice / 500 END AS power,
    81 + l_extendedprice / 500 AS power_px, sign(l_quantity * 2 - 2 + l_tax * 25) AS util,
    l_quantity * 2 - 2 + l_tax * 25 AS cpuload_total, l_quantity - 1 AS loadavg,
    CASE WHEN l_orderkey % 89 = 1 THEN -1.0::DOUBLE ELSE 18 + l_discount * 50 END AS inlet_temp,
    30 + l_discount * 50 AS exhaust_temp,
    CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_linenumber = 7 AND l_orderkey % 3 = 0 THEN NULL
      ELSE (80 + l_extendedprice / 500) * 0.4::DOUBLE END AS cpu_power,
    CASE WHEN l_suppkey % 2 = 0 THEN 3000 + l_quantity END AS fan1
  FROM lineitem
)"""


def sql_cpu_class(load: str, threshold: float) -> str:
    return (
        f"CASE WHEN {load} <= {threshold} THEN 0 WHEN {load} <= 10 THEN 1 WHEN {load} <= 40 THEN 2 ELSE 3 END"
    )


def sql_loadavg_class(load: str) -> str:
    return (
        f"CASE WHEN {load} < 0.03 THEN 0 WHEN {load} <= 10 THEN 1 WHEN {load} <= 40 THEN 2 ELSE 3 END"
    )


# -- curated machines and hardware texts from part ---------------------------------

def _times(n: Column, build) -> Column:
    """Array of ``build(i)`` for i below n; empty when n is 0."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(0))), lambda i: i < n), build)


def part_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Hardware figures of one machine per part.

    A part is a few bytes in its file and kilobytes as a machine, so parts are dealt over tasks first: as many as their
    number asks for, so that what a task holds does not grow with the table.
    """
    size = F.col("p_size")
    parts = read(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts.count() // MACHINES_PER_TASK))
    return parts.repartition(tasks, "p_partkey").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("hostname"),
        F.col("p_partkey").alias("position"), F.col("p_brand").alias("system_product"),
        F.concat(F.lit("Vendor"), (size % 3).cast("string")).alias("system_vendor"),
        F.concat(F.lit("CPU "), F.col("p_type")).alias("cpu"), (1 + size % 2).alias("n_cpu"),
        (F.lit(2 * 10**9).cast("bigint") + 10**8 * (size % 7)).alias("hertz"),
        (4 * (1 + size % 4)).cast("bigint").alias("cpu_cores"), (size % 5).alias("n_mem"),
        (F.lit(8589934592) * (1 + size % 2)).alias("bank"), (1 + size % 2).alias("n_psu"),
        (size % 4).alias("n_disk"), (1 + size % 2).alias("n_nic"), size.alias("size"),
        F.when(size % 5 == 0, "GP102 [TITAN Xp]").when(size % 5 == 1, "Unlisted GPU").alias("gpu"),
        (size == 50).alias("bad_unit"), "p_partkey",
    )


def disk_product(size: Column, i: Column) -> Column:
    return F.concat(F.lit("D"), ((size + i) % 3).cast("string"))


def curated_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same machines as curated documents."""
    disk = lambda i: F.struct(
        F.lit("DV").alias("vendor"), disk_product(F.col("size"), i).alias("product"),
        ((i + 1) * F.lit(10**12)).cast("bigint").alias("size"),
    )
    gpu = F.struct(
        F.lit("NV").alias("vendor"), F.col("gpu").alias("product"),
        F.when(F.col("gpu") == "GP102 [TITAN Xp]", 12150).otherwise(0).cast("bigint").alias("mflops"),
    )
    cores = F.col("n_cpu") * F.col("cpu_cores")
    return part_facts(spark, folder).select(
        "hostname", "position", F.lit(None).cast("string").alias("owner"), F.lit("lab").alias("pool"),
        F.concat(F.lit("s"), "hostname").alias("system_id"), F.lit(True).alias("inband"),
        "system_vendor", "system_product", cores.alias("cores"), (cores * 2).alias("threads"),
        (cores * 2 * (F.col("hertz") / 10**9) * 16).alias("mflops"), F.lit("Intel").alias("processor_vendor"),
        _times(F.col("n_cpu"), lambda i: F.col("cpu")).alias("processor_product"),
        _times(F.col("n_mem"), lambda i: F.col("bank")).alias("memory_modules"),
        _times(F.col("n_psu"), lambda i: F.lit(750).cast("bigint")).alias("psus"),
        _times(F.col("n_disk"), disk).alias("disks"),
        _times(F.col("n_nic"), lambda i: F.struct(F.lit("N").alias("vendor"), F.lit("E10").alias("product"))).alias("nics"),
        F.when(F.col("gpu").isNotNull(), F.array(gpu)).otherwise(F.array().cast(
            "array<struct<vendor:string,product:string,mflops:bigint>>")).alias("accelerators"),
    )


PARTS = """
hw AS (
  SELECT 'p' || p_partkey AS hostname, p_partkey AS position, p_brand AS system_product,
    'Vendor' || (p_size % 3) AS system_vendor, 'CPU ' || p_type AS cpu, 1 + p_size % 2 AS n_cpu,
    CAST((1 + p_size % 2) * 4 * (1 + p_size % 4) AS BIGINT) AS cores,
    (2000000000::BIGINT + 100000000 * (p_size % 7)) / 1000000000.0::DOUBLE AS ghz, p_size % 5 AS n_mem,
    (p_size % 5) * 8.589934592::DOUBLE * (1 + p_size % 2) AS mem_gb, 1 + p_size % 2 AS n_psu,
    p_size % 4 AS n_disk, CAST((p_size % 4) * (p_size % 4 + 1) / 2 AS DOUBLE) AS disk_tb, 1 + p_size % 2 AS n_nic,
    p_size AS size, CASE p_size % 5 WHEN 0 THEN 'GP102 [TITAN Xp]' WHEN 1 THEN 'Unlisted GPU' END AS gpu,
    p_size = 50 AS bad_unit
  FROM part
)"""

# One row per machine and listed value, in list order.
PART_VALUES = f"""{PARTS},
vals AS (
  SELECT hostname, position, 0 AS list_pos, 'hostname' AS attribute, hostname AS value FROM hw
  UNION ALL SELECT hostname, position, 0, 'system_vendor', system_vendor FROM hw
  UNION ALL SELECT hostname, position, 0, 'system_product', system_product FROM hw
  UNION ALL SELECT hostname, position, 0, 'processor_vendor', 'Intel' FROM hw
  UNION ALL SELECT hostname, position, i, 'processor_product', cpu FROM hw, range(2) r(i) WHERE i < n_cpu
  UNION ALL SELECT hostname, position, 0, 'accelerators', gpu FROM hw WHERE gpu IS NOT NULL
  UNION ALL SELECT hostname, position, i, 'disks', 'D' || ((size + i) % 3) FROM hw, range(4) r(i) WHERE i < n_disk
  UNION ALL SELECT hostname, position, i, 'nics', 'E10' FROM hw, range(2) r(i) WHERE i < n_nic
)"""


def hardware_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Details text of each machine: neighbour and hardware document, in either order."""
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    nodes = lambda n, build: F.array_join(_times(F.col(n), build), "")
    cpu = lambda i: text(
        '<node id="cpu:', s(i), '" class="processor"><product>', s("cpu"), "</product><vendor>Intel</vendor>",
        '<size units="Hz">', s("hertz"), '</size><configuration><setting id="cores" value="', s("cpu_cores"),
        '"/><setting id="enabledcores" value="99"/><setting id="threads" value="', s(F.col("cpu_cores") * 2),
        '"/></configuration><node id="cache:0" class="memory"><size units="bytes">1</size></node></node>',
    )
    bank = lambda i: text('<node id="bank:', s(i), '" class="memory"><size units="bytes">', s("bank"), "</size></node>")
    psu = lambda i: text(
        '<node id="power:', s(i), '" class="power"><capacity units="',
        F.when(F.col("bad_unit"), "W").otherwise("mWh"), '">750</capacity></node>',
    )
    disk = lambda i: text(
        '<node id="disk:', s(i), '" class="disk"><vendor>DV</vendor><product>', disk_product(F.col("size"), i),
        '</product><size units="bytes">', s((i + 1) * F.lit(10**12)), "</size></node>",
    )
    nic = lambda i: text('<node id="network:', s(i), '" class="network"><vendor>N</vendor><product>E10</product></node>')
    gpu = F.when(
        F.col("gpu").isNotNull(),
        text('<node id="display:1" class="display"><vendor>NV</vendor><product>', s("gpu"), "</product></node>"),
    ).otherwise("")
    hardware = text(
        '<?xml version="1.0"?><list><node id="m" class="system"><product>', s("system_product"), "</product><vendor>",
        s("system_vendor"), '</vendor><node id="core" class="bus">', nodes("n_cpu", cpu), nodes("n_mem", bank),
        '<node id="bank:9" class="memory"/>', nodes("n_psu", psu), nodes("n_disk", disk),
        '<node id="disk:9" class="disk"><product>D9</product><size units="bytes">6000</size></node>',
        nodes("n_nic", nic),
        '<node id="display:0" class="display"><vendor>Matrox X</vendor><product>G200</product></node>', gpu,
        "</node></node></list>\n",
    )
    lldp = F.when(F.col("p_partkey") % 3 == 0, '<?xml version="1.0"?><lldp label="x"/>\n').otherwise(text(
        '<?xml version="1.0"?><lldp label="x"><interface name="eth', s(F.col("p_partkey") % 4),
        '"><chassis><id type="mac">00:', s("p_partkey"), '</id></chassis><vlan vlan-id="', s("size"),
        '"/></interface></lldp>\n',
    ))
    both = bind(hardware, lambda h: F.when(F.col("p_partkey") % 2 == 0, F.concat(lldp, h)).otherwise(F.concat(h, lldp)))
    facts = part_facts(spark, folder)
    return facts.select("hostname", "position", both.alias("details"))


def part_machines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw machine documents of the hardware texts."""
    none = F.array().cast("array<string>")
    return part_facts(spark, folder).select(
        "hostname", F.concat(F.lit("s"), "hostname").alias("system_id"), F.lit("user1").alias("owner"),
        F.struct(F.lit("lab").alias("name")).alias("pool"), F.lit("Deployed").alias("status_name"),
        none.alias("tag_names"), F.array(F.lit("10.0.0.1")).alias("ip_addresses"),
        F.concat(F.lit("user:cse_bot;rack:r"), F.col("size").cast("string")).alias("description"),
    )
