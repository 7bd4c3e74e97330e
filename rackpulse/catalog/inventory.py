"""Hardware texts, totals, dictionaries and hardware groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from rackpulse.catalog import tables as t
from rackpulse.catalog.tables import PART_VALUES, PARTS, fixed, sql_fixed
from rackpulse.operators import inventory as inv
from rackpulse.session import materialise

# -- hardware texts --------------------------------------------------------------


def _curated(spark, d):
    return inv.curate_machines(t.part_machines(spark, d), t.hardware_texts(spark, d))


def xml_inventory(spark, d):
    curated, _ = _curated(spark, d)
    products = lambda c: F.array_join(F.transform(c, lambda p: p["product"]), ",")
    return curated.select(
        "hostname", "owner", "pool", "inband", "system_vendor", "system_product", "cores", "threads",
        fixed("mflops").alias("mflops"), "processor_vendor", F.array_join("processor_product", ",").alias("processors"),
        F.array_join(F.col("memory_modules").cast("array<string>"), ",").alias("memory"),
        F.size("psus").alias("n_psu"), products("disks").alias("disks"),
        F.array_join(F.transform("disks", lambda x: x["size"].cast("string")), ",").alias("disk_sizes"),
        products("nics").alias("nics"), products("accelerators").alias("accelerators"),
        F.aggregate("accelerators", F.lit(0).cast("bigint"), lambda a, x: a + x["mflops"]).alias("gpu_units"),
        "ip_address", "user", "rack", "unit",
    )


XML_INVENTORY = f"""
WITH {PARTS}
SELECT hostname, 'user1' AS owner, 'lab' AS pool, true AS inband, system_vendor, system_product, cores,
  cores * 2 AS threads, {sql_fixed('cores * 2 * ghz * 16')} AS mflops, 'Intel' AS processor_vendor,
  CASE n_cpu WHEN 1 THEN cpu ELSE cpu || ',' || cpu END AS processors,
  array_to_string([CAST(8589934592 * (1 + size % 2) AS VARCHAR) FOR x IN range(n_mem)], ',') AS memory,
  n_psu, array_to_string(['D' || ((size + x) % 3) FOR x IN range(n_disk)], ',') AS disks,
  array_to_string([CAST((x + 1) * 1000000000000 AS VARCHAR) FOR x IN range(n_disk)], ',') AS disk_sizes,
  CASE n_nic WHEN 1 THEN 'E10' ELSE 'E10,E10' END AS nics, coalesce(gpu, '') AS accelerators,
  CAST(CASE WHEN size % 5 = 0 THEN 12150 ELSE 0 END AS BIGINT) AS gpu_units,
  '10.0.0.1' AS ip_address, 'cse_bot' AS "user", 'r' || size AS rack, CAST(NULL AS VARCHAR) AS unit
FROM hw WHERE NOT bad_unit"""


def xml_rejects(spark, d):
    return _curated(spark, d)[1]


def xml_neighbours(spark, d):
    return inv.neighbour_links(t.hardware_texts(spark, d))


XML_NEIGHBOURS = f"""
WITH {PARTS}
SELECT hostname, 'eth' || (position % 4) AS interface, '00:' || position AS mac, CAST(size AS VARCHAR) AS vlan
FROM hw WHERE position % 3 <> 0"""

# -- totals ------------------------------------------------------------------------


def hw_totals(spark, d):
    totals = inv.hardware_totals(t.curated_parts(spark, d))
    return totals.select(
        *[c for c in totals.columns if c not in ("mflops", "memory_capacity", "disk_capacity")],
        *[fixed(c).alias(c) for c in ("mflops", "memory_capacity", "disk_capacity")],
    )


HW_TOTALS = f"""
WITH {PARTS}
SELECT hostname, cores, cores * 2 AS threads, n_cpu AS processor_count, n_mem AS memory_mod_count,
  CAST(CASE WHEN gpu IS NULL THEN 0 ELSE 1 END AS INT) AS accelerator_count, n_disk AS disk_count, n_nic AS nic_count,
  n_psu AS psu_count, {sql_fixed('cores * 2 * ghz * 16')} AS mflops, {sql_fixed('mem_gb')} AS memory_capacity,
  {sql_fixed('disk_tb')} AS disk_capacity FROM hw"""


def fleet_compute(spark, d):
    return inv.fleet_compute(t.curated_parts(spark, d)).select("kind", fixed("tflops", 3).alias("tflops"))


FLEET_COMPUTE = f"""
WITH {PARTS}, k AS (
  SELECT 'cpu' AS kind, sum(cores * 2 * ghz * 16) / 1000 AS tflops FROM hw
  UNION ALL SELECT 'gpu', sum(CASE WHEN gpu = 'GP102 [TITAN Xp]' THEN 12150.0::DOUBLE ELSE 0 END) / 1000 FROM hw)
SELECT kind, {sql_fixed('tflops', 3)} AS tflops FROM k
UNION ALL SELECT 'total', {sql_fixed('sum(tflops)', 3)} FROM k"""

# -- dictionaries --------------------------------------------------------------------


def label_dictionary(spark, d):
    values = inv.attribute_values(t.curated_parts(spark, d))
    return inv.label_dictionary(values, {"system_product": "1-hot", "disks": "n-hot"})


LABEL_DICTIONARY = f"""
WITH {PART_VALUES}, f AS (
  SELECT attribute, value, min(position * 10 + list_pos) AS first, count(DISTINCT hostname) AS n_machines
  FROM vals GROUP BY 1, 2)
SELECT attribute, CASE attribute WHEN 'system_product' THEN '1-hot' WHEN 'disks' THEN 'n-hot' ELSE 'label' END AS encoding,
  value, row_number() OVER (PARTITION BY attribute ORDER BY first, value) - 1 AS code, n_machines FROM f"""


def dictionary_members(spark, d):
    return inv.dictionary_members(inv.attribute_values(t.curated_parts(spark, d)))


def part_counts(spark, d):
    return inv.part_counts(inv.attribute_values(t.curated_parts(spark, d)))


def _features(spark, d, encodings):
    machines = t.curated_parts(spark, d)
    dictionary = materialise(inv.label_dictionary(inv.attribute_values(machines)), "codes")
    return inv.static_features(machines, dictionary, encodings)


def static_features(spark, d):
    """Label codes for product and processor, counts per accelerator, disk and network product."""
    wide = _features(spark, d, {"system_product": "label", "processor_product": "label"})
    return wide.drop("owner", "inband")


STATIC_FEATURES = f"""
WITH {PART_VALUES}, dict AS (
  SELECT attribute, value, row_number() OVER (PARTITION BY attribute ORDER BY min(position * 10 + list_pos)) - 1 AS code
  FROM vals WHERE attribute IN ('system_product', 'processor_product') GROUP BY 1, 2)
SELECT hostname, 'lab' AS pool, n_cpu AS processor_count, cores AS processor_cores, n_mem AS memory_mod_count,
  round(mem_gb, 2) AS memory_capacity, CAST(CASE WHEN gpu IS NULL THEN 0 ELSE 1 END AS INT) AS accelerator_count,
  n_disk AS disk_count, round(disk_tb, 2) AS disk_capacity, n_nic AS nic_count,
  s.code AS system_product, p.code AS processor_product,
  CAST(coalesce(gpu = 'GP102 [TITAN Xp]', false) AS INT) AS "accel_GP102 [TITAN Xp]",
  CAST(coalesce(gpu = 'Unlisted GPU', false) AS INT) AS "accel_Unlisted GPU",
  CAST(CASE WHEN n_disk > (3 - size % 3) % 3 THEN 1 ELSE 0 END AS INT) AS "disk_D0",
  CAST(CASE WHEN n_disk > (4 - size % 3) % 3 THEN 1 ELSE 0 END AS INT) AS "disk_D1",
  CAST(CASE WHEN n_disk > (5 - size % 3) % 3 THEN 1 ELSE 0 END AS INT) AS "disk_D2", n_nic AS "nic_E10"
FROM hw JOIN dict s ON s.attribute = 'system_product' AND s.value = hw.system_product
JOIN dict p ON p.attribute = 'processor_product' AND p.value = hw.cpu"""


def one_hot_features(spark, d):
    """One column per brand and processor type, back in long form to keep the names data-free."""
    wide = _features(spark, d, {"system_product": "1-hot", "processor_product": "1-hot"})
    names = [c for c in wide.columns if c.startswith(("sp_", "pp_"))]
    return wide.select("hostname", *[F.col(f"`{c}`") for c in names]).unpivot(
        ["hostname"], [f"`{c}`" for c in names], "feature", "n"
    )


ONE_HOT = f"""
WITH {PARTS}, sp AS (SELECT DISTINCT system_product AS v FROM hw), pp AS (SELECT DISTINCT cpu AS v FROM hw)
SELECT hostname, 'sp_' || v AS feature, CAST(system_product = v AS INT) AS n FROM hw CROSS JOIN sp
UNION ALL SELECT hostname, 'pp_' || v, CASE WHEN cpu = v THEN n_cpu ELSE 0 END FROM hw CROSS JOIN pp"""

def one_hot_hostname(spark, d):
    """Host names and parts of all machines as sparse vectors, one row per index."""
    values = inv.attribute_values(t.curated_parts(spark, d)).where(F.col("attribute").isin("hostname", "disks", "nics"))
    vectors = inv.sparse_features(values, inv.label_dictionary(values))
    return vectors.select("hostname", "attribute", "size", F.inline(F.arrays_zip("indices", "counts"))).withColumnsRenamed(
        {"indices": "code", "counts": "n"}
    )


ONE_HOT_HOSTNAME = f"""
WITH {PART_VALUES}, codes AS (
  SELECT attribute, value, row_number() OVER (PARTITION BY attribute ORDER BY min(position * 10 + list_pos), value) - 1 AS code,
    count(*) OVER (PARTITION BY attribute) AS size
  FROM vals WHERE attribute IN ('hostname', 'disks', 'nics') GROUP BY 1, 2)
SELECT hostname, attribute, any_value(size) AS size, code, count(*) AS n FROM vals JOIN codes USING (attribute, value)
GROUP BY hostname, attribute, code"""

# -- hardware groups -------------------------------------------------------------------


def hwconfig_groups(spark, d):
    return inv.hardware_groups(t.curated_parts(spark, d)).select("code", "first", "n_machines")


# Fewer disks than kinds: the products present depend on where the numbering starts.
_DISK_KEY = "CASE WHEN n_disk = 0 THEN -1 WHEN n_disk = 3 THEN 3 ELSE size % 3 END"
GROUPS = f"""{PARTS}, keyed AS (SELECT *, {_DISK_KEY} AS disk_key FROM hw),
grp AS (
  SELECT system_product, cpu, n_cpu, cores, n_mem, mem_gb, gpu, n_disk, disk_key, n_nic,
    min(position) AS first, count(*) AS n_machines FROM keyed GROUP BY ALL)"""


def hwconfig_members(spark, d):
    return inv.coded_members(t.curated_parts(spark, d))


HWCONFIG_MEMBERS = f"""
WITH {GROUPS}, coded AS (SELECT *, row_number() OVER (ORDER BY first) - 1 AS code FROM grp)
SELECT k.hostname, c.code FROM keyed k JOIN coded c ON k.system_product = c.system_product AND k.cpu = c.cpu
  AND k.n_cpu = c.n_cpu AND k.cores = c.cores AND k.n_mem = c.n_mem AND k.mem_gb = c.mem_gb
  AND k.gpu IS NOT DISTINCT FROM c.gpu AND k.n_disk = c.n_disk AND k.disk_key = c.disk_key AND k.n_nic = c.n_nic"""


def groups_with_data(spark, d):
    """Machines of a hardware group that have samples: parts sold at least once."""
    members = inv.hardware_members(t.curated_parts(spark, d))
    sold = t.read(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("host")
    )
    return inv.members_with_samples(members, sold).select("hostname")


def default_subset(spark, d):
    return inv.default_subset(inv.hardware_members(t.curated_parts(spark, d)))


DEFAULT_SUBSET = f"""
WITH {PARTS}, keyed AS (SELECT *, {_DISK_KEY} AS disk_key FROM hw)
SELECT min(hostname) AS hostname FROM keyed
GROUP BY system_product, cpu, n_cpu, cores, n_mem, mem_gb, gpu, n_disk, disk_key, n_nic"""

QUERIES = {
    "xml_inventory": (xml_inventory, XML_INVENTORY),
    "xml_rejects": (
        xml_rejects,
        f"WITH {PARTS} SELECT hostname, 'power capacity not in mWh' AS reason FROM hw WHERE bad_unit",
    ),
    "xml_neighbours": (xml_neighbours, XML_NEIGHBOURS),
    "hw_totals": (hw_totals, HW_TOTALS),
    "fleet_compute": (fleet_compute, FLEET_COMPUTE),
    "label_dictionary": (label_dictionary, LABEL_DICTIONARY),
    "dictionary_members": (
        dictionary_members, f"WITH {PART_VALUES} SELECT DISTINCT attribute, value, hostname FROM vals"
    ),
    "part_counts": (
        part_counts, f"WITH {PART_VALUES} SELECT hostname, attribute, value, count(*) AS n FROM vals GROUP BY 1, 2, 3"
    ),
    "static_features": (static_features, STATIC_FEATURES),
    "one_hot_features": (one_hot_features, ONE_HOT),
    "one_hot_hostname": (one_hot_hostname, ONE_HOT_HOSTNAME),
    "hwconfig_groups": (
        hwconfig_groups,
        f"WITH {GROUPS} SELECT row_number() OVER (ORDER BY first) - 1 AS code, first, n_machines FROM grp",
    ),
    "hwconfig_members": (hwconfig_members, HWCONFIG_MEMBERS),
    "groups_with_data": (
        groups_with_data, "SELECT DISTINCT 'p' || l_partkey AS hostname FROM lineitem "
        "WHERE l_partkey IN (SELECT p_partkey FROM part)",
    ),
    "default_subset": (default_subset, DEFAULT_SUBSET),
}
