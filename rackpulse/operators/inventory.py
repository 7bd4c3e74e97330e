"""Machine selection, hardware curation, dictionaries and hardware groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions import hardware as hw
from rackpulse.functions.parse import description_field
from rackpulse.functions.status import OFF, UNKNOWN
from rackpulse.operators.ranking import rank_in_group
from rackpulse.operators.skew import last_wins, keyed_join
from rackpulse.session import materialise
from rackpulse.sources.dimensions import GPU_UNITS

# States and tags that keep a machine out, and the marker of the service account.
VIRTUAL_TAG = "virtual"
NOT_COMMISSIONED = ("New", "Failed commissioning")
IN_COMMISSIONING = "Commissioning"
SERVICE_ACCOUNT = "cse_bot"

GIGABYTE, TERABYTE = 1000**3, 1000**4
DICTIONARY_ATTRIBUTES = (
    "hostname", "system_vendor", "system_product", "processor_vendor", "processor_product",
    "accelerators", "disks", "nics",
)


# -- selection ---------------------------------------------------------------

def inventory_machines(machines: DataFrame, commissioning_too: bool = False) -> DataFrame:
    """Machines with inventory: real ones past commissioning."""
    closed = NOT_COMMISSIONED if commissioning_too else (*NOT_COMMISSIONED, IN_COMMISSIONING)
    return machines.where(
        ~F.array_contains("tag_names", VIRTUAL_TAG) & ~F.col("status_name").isin(*closed)
    )


def telemetry_machines(
    machines: DataFrame, skip_list: DataFrame, states: list[str] | None = None
) -> DataFrame:
    """Machines the collectors poll: real, not skipped, past New, in a requested state, with an address."""
    kept = machines.where(
        ~F.array_contains("tag_names", VIRTUAL_TAG)
        & (F.col("status_name") != "New") & (F.size("ip_addresses") > 0)
    )
    if states:
        kept = kept.where(F.col("status_name").isin(*states))
    return without(kept, skip_list)


def without(machines: DataFrame, skip_list: DataFrame, key: str = "hostname") -> DataFrame:
    return machines.join(skip_list.select(key), key, "left_anti")


def only(machines: DataFrame, subset: DataFrame, key: str = "hostname") -> DataFrame:
    """Restriction to a chosen subset."""
    return machines.join(subset.select(key), key, "left_semi")


def with_power_parameters(machines: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds driver, address and user of the power controller; the password never leaves the scan."""
    return machines.join(parameters.drop("power_pass"), "hostname", "left")


def override_with(managed: DataFrame, unmanaged: DataFrame, key: str = "hostname") -> DataFrame:
    """Union in which an unmanaged machine replaces a managed one of the same name."""
    both = managed.withColumn("_rank_source", F.lit(0)).unionByName(
        unmanaged.withColumn("_rank_source", F.lit(1)), allowMissingColumns=True
    )
    return last_wins(both, [key], ["_rank_source"]).drop("_rank_source")


def inband_access(power_state: str = "power_state", user: str = "user") -> Column:
    """Code stored instead of a reading when a host cannot be asked, or null when it can."""
    state = F.col(power_state)
    return (
        F.when(state == "off", OFF).when(F.coalesce(state != "on", F.lit(True)), UNKNOWN)
        .when(F.coalesce(F.length(user), F.lit(0)) == 0, UNKNOWN)
    )


def bmc_access(fields: list[str], power_state: str = "power_state") -> Column:
    """Unknown code when the controller cannot be asked: state error or a missing field."""
    missing = F.col(power_state).isNull()
    for field in fields:
        missing = missing | F.col(field).isNull()
    return F.when(missing | (F.col(power_state) == "error"), UNKNOWN)


def first_address(addresses: str = "ip_addresses") -> Column:
    return F.try_element_at(F.col(addresses), F.lit(1))


# -- curation ----------------------------------------------------------------

def curate_machines(
    machines: DataFrame, details: DataFrame, service_account: str = SERVICE_ACCOUNT
) -> tuple[DataFrame, DataFrame]:
    """Curated machines and rejected ones.

    ``details`` holds ``hostname`` and the details text. A document that cannot be
    read or has a size in an unexpected unit goes to the rejects with the reason.
    """
    # Plans guess a text at 20 bytes and would send all details through the driver; they stay where they are dealt.
    joined = inventory_machines(machines, commissioning_too=True).hint("shuffle_hash").join(details, "hostname")
    parsed = joined.withColumn("xml", hw.hardware_nodes(hw.details_document("details", "list"))).drop("details")
    checked = parsed.withColumn("reason", hw.document_error(F.col("xml")))
    rejects = checked.where("reason IS NOT NULL").select("hostname", "reason")
    xml = F.col("xml")
    nodes = checked.where("reason IS NULL").select(
        "*", hw.system_of(xml).alias("sys"), hw.processors_of(xml).alias("cpu")
    )
    curated = nodes.select(
        "hostname", "owner", F.col("pool.name").alias("pool"), "system_id",
        F.coalesce(F.contains("description", F.lit(service_account)), F.lit(False)).alias("inband"),
        F.col("sys.vendor").alias("system_vendor"), F.col("sys.product").alias("system_product"),
        F.col("cpu.cores").alias("cores"), F.col("cpu.threads").alias("threads"),
        F.col("cpu.mflops").alias("mflops"), F.col("cpu.vendor").alias("processor_vendor"),
        F.col("cpu.products").alias("processor_product"),
        hw.memory_of(xml).alias("memory_modules"), hw.power_supplies_of(xml).alias("psus"),
        hw.disks_of(xml).alias("disks"), hw.nics_of(xml).alias("nics"),
        hw.accelerators_of(xml, GPU_UNITS).alias("accelerators"),
        first_address().alias("ip_address"),
        *[description_field("description", k).alias(k) for k in ("user", "rack", "unit")],
    )
    return curated, rejects


def neighbour_links(details: DataFrame) -> DataFrame:
    """Host, interface, chassis id and vlan of every network neighbour."""
    return details.select(
        "hostname",
        F.explode(hw.neighbours_of(hw.details_document("details", "lldp"))).alias("n"),
    ).select("hostname", "n.*")


# -- totals ------------------------------------------------------------------

def _sum_of(array: str, field: str | None = None) -> Column:
    def add(acc: Column, x: Column) -> Column:
        return acc + (x[field] if field else x)

    return F.aggregate(F.col(array), F.lit(0).cast("bigint"), add)


def hardware_totals(machines: DataFrame) -> DataFrame:
    """Counts and capacities of each machine's parts."""
    return machines.select(
        "hostname", "cores", "threads", "mflops",
        F.size("processor_product").alias("processor_count"),
        F.size("memory_modules").alias("memory_mod_count"),
        (_sum_of("memory_modules") / GIGABYTE).alias("memory_capacity"),
        F.size("accelerators").alias("accelerator_count"),
        F.size("disks").alias("disk_count"),
        (_sum_of("disks", "size") / TERABYTE).alias("disk_capacity"),
        F.size("nics").alias("nic_count"),
        F.size("psus").alias("psu_count"),
    )


def fleet_compute(machines: DataFrame) -> DataFrame:
    """Compute of all processors and all accelerators in thousands, and the grand total."""
    kinds = machines.select(
        F.struct(
            F.col("mflops").alias("cpu"), _sum_of("accelerators", "mflops").cast("double").alias("gpu")
        ).alias("m")
    ).select("m.*").unpivot([], ["cpu", "gpu"], "kind", "mflops")
    return kinds.rollup("kind").agg((F.sum("mflops") / 1000).alias("tflops")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "tflops"
    )


# -- dictionaries ------------------------------------------------------------

def _products(column: str) -> Column:
    return F.transform(F.col(column), lambda part: part["product"])


def attribute_values(machines: DataFrame, position: str = "position") -> DataFrame:
    """Every (attribute, value) of every machine with its place: machine, then list index."""
    one = lambda c: F.array(F.col(c))
    lists = {
        "hostname": one("hostname"), "system_vendor": one("system_vendor"),
        "system_product": one("system_product"), "processor_vendor": one("processor_vendor"),
        "processor_product": F.col("processor_product"), "accelerators": _products("accelerators"),
        "disks": _products("disks"), "nics": _products("nics"),
    }
    attributes = F.array(*[
        F.struct(F.lit(a).alias("attribute"), lists[a].alias("vals")) for a in DICTIONARY_ATTRIBUTES
    ])
    return (
        machines.select("hostname", F.col(position).alias("machine_pos"), F.explode(attributes).alias("a"))
        .select("hostname", "machine_pos", "a.attribute", F.posexplode("a.vals").alias("list_pos", "value"))
        .where("value IS NOT NULL")
    )


def label_dictionary(values: DataFrame, encodings: dict[str, str] | None = None) -> DataFrame:
    """Dense codes of distinct values in order of first appearance, with machine counts."""
    seen = values.groupBy("attribute", "value", "hostname").agg(
        F.min(F.struct("machine_pos", "list_pos")).alias("first")
    )
    # Written once: ranking reads it twice, and it is far smaller than the machine documents.
    distinct = materialise(
        seen.groupBy("attribute", "value").agg(F.min("first").alias("first"), F.count("*").alias("n_machines")),
        "dictionary",
    )
    chosen = encodings or {}
    encoding = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in chosen.items() for x in p]), F.col("attribute"))
        if chosen else F.lit(None).cast("string"),
        F.lit("label"),
    )
    ranked = rank_in_group(
        distinct, ["attribute"], F.floor(F.col("first.machine_pos") / 4096),
        [F.col("first.machine_pos"), F.col("first.list_pos"), F.col("value")], "_rank",
    )
    return ranked.select(
        "attribute", encoding.alias("encoding"), "value",
        (F.col("_rank") - 1).cast("bigint").alias("code"), "n_machines",
    )


def dictionary_members(values: DataFrame) -> DataFrame:
    """Machines of each dictionary value, one row each."""
    return values.select("attribute", "value", "hostname").distinct()


def vocabularies(dictionary: DataFrame, attributes: list[str]) -> dict[str, list[str]]:
    """Sorted values of each attribute, for use as column names.

    A plan has its column names on the driver; for a vocabulary that grows with the fleet use
    ``sparse_features``, which keeps it in the cluster.
    """
    chosen = dictionary.where(F.col("attribute").isin(attributes))
    words: dict[str, list[str]] = {a: [] for a in attributes}
    for row in chosen.select("attribute", "value").collect():
        words[row["attribute"]].append(row["value"])
    return {a: sorted(w) for a, w in words.items()}


def part_counts(values: DataFrame) -> DataFrame:
    """N-hot encoding in long form: how often a machine has each value."""
    return values.groupBy("hostname", "attribute", "value").agg(F.count("*").alias("n"))


def sparse_features(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """1-hot and n-hot encoding of any vocabulary: a sparse vector per machine and attribute.

    ``indices`` are the dictionary's codes, ascending, ``counts`` how often the machine has the value, ``size`` the
    number of codes. Neither the vocabulary nor a machine's row grows with the fleet, only the number of rows.
    """
    codes = dictionary.select("attribute", "value", "code")
    sizes = dictionary.groupBy("attribute").agg(F.count("*").alias("size"))
    held = keyed_join(part_counts(values), codes, ["attribute", "value"])
    pairs = held.groupBy("hostname", "attribute").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("p"))
    return keyed_join(pairs, sizes, ["attribute"]).select(
        "hostname", "attribute", "size", F.col("p.code").alias("indices"), F.col("p.n").alias("counts")
    )


def n_hot(values: Column, words: list[str], prefix: str) -> list[Column]:
    """One count column per vocabulary word."""
    def count_of(word: str) -> Column:
        return F.size(F.filter(values, lambda v: v == F.lit(word)))

    return [count_of(word).alias(f"{prefix}{word}") for word in words]


def static_features(
    machines: DataFrame, dictionary: DataFrame, encodings: dict[str, str], sparse: tuple[str, ...] = ()
) -> DataFrame:
    """Wide hardware features per machine; the attributes in ``sparse`` are left to ``sparse_features``.

    ``encodings`` gives ``1-hot`` or ``label`` for hostname, system_product and
    processor_product; accelerators, disks and nics are n-hot.
    """
    df = machines
    columns: list[Column] = []
    hot = [a for a, e in encodings.items() if e == "1-hot"]
    words = vocabularies(dictionary, [*hot, *(a for a in ("accelerators", "disks", "nics") if a not in sparse)])
    singles = (("hostname", "hn_", F.array("hostname")), ("system_product", "sp_", F.array("system_product")),
               ("processor_product", "pp_", F.col("processor_product")))
    for attribute, prefix, values in singles:
        if encodings.get(attribute) == "1-hot":
            columns += n_hot(values, words[attribute], prefix)
        elif encodings.get(attribute) == "label":
            codes = dictionary.where(F.col("attribute") == attribute).select(
                F.col("value").alias("_value"), F.col("code").alias(f"_{attribute}")
            )
            df = df.withColumn("_value", F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("")))
            if attribute == "hostname":  # one machine per value, nothing to spread
                df = df.join(codes, "_value", "left").drop("_value")
            else:
                df = keyed_join(df, codes, ["_value"], "left").drop("_value")
            columns.append(F.col(f"_{attribute}").alias(
                "hostname_code" if attribute == "hostname" else attribute
            ))
    for attribute, prefix in (("accelerators", "accel_"), ("disks", "disk_"), ("nics", "nic_")):
        if attribute in sparse:
            continue
        columns += n_hot(_products(attribute), words[attribute], prefix)
    totals = [
        F.size("processor_product").alias("processor_count"),
        F.col("cores").alias("processor_cores"),
        F.size("memory_modules").alias("memory_mod_count"),
        F.round(_sum_of("memory_modules") / GIGABYTE, 2).alias("memory_capacity"),
        F.size("accelerators").alias("accelerator_count"),
        F.size("disks").alias("disk_count"),
        F.round(_sum_of("disks", "size") / TERABYTE, 2).alias("disk_capacity"),
        F.size("nics").alias("nic_count"),
    ]
    return df.select("hostname", "owner", "pool", "inband", *totals, *columns)


def hardware_key(processor_label: bool = False) -> Column:
    """Text that is equal for machines with equal hardware features."""
    processors = (
        F.slice("processor_product", 1, 1) if processor_label else F.array_sort("processor_product")
    )
    return F.to_json(F.struct(
        F.col("system_product"), processors.alias("processors"),
        F.size("processor_product").alias("processor_count"), F.col("cores"),
        F.size("memory_modules").alias("memory_mod_count"),
        F.round(_sum_of("memory_modules") / GIGABYTE, 2).alias("memory_capacity"),
        F.array_sort(_products("accelerators")).alias("accelerators"),
        F.array_sort(_products("disks")).alias("disks"),
        F.round(_sum_of("disks", "size") / TERABYTE, 2).alias("disk_capacity"),
        F.array_sort(_products("nics")).alias("nics"),
    ))


def hardware_groups(
    machines: DataFrame, position: str = "position", processor_label: bool = False
) -> DataFrame:
    """Distinct hardware configurations, coded in order of first appearance."""
    found = machines.withColumn("hwconfig", hardware_key(processor_label)).groupBy("hwconfig").agg(
        F.min(position).alias("first"), F.count("*").alias("n_machines")
    )
    groups = materialise(found, "hwconfigs").withColumn("_all", F.lit(0))
    ranked = rank_in_group(groups, ["_all"], F.floor(F.col("first") / 4096), ["first"], "_rank")
    return ranked.select("hwconfig", (F.col("_rank") - 1).cast("bigint").alias("code"), "first", "n_machines")


def hardware_members(machines: DataFrame, processor_label: bool = False) -> DataFrame:
    """Hardware configuration of each machine."""
    return machines.select(hardware_key(processor_label).alias("hwconfig"), "hostname")


def coded_members(machines: DataFrame, position: str = "position") -> DataFrame:
    """Code of each machine's hardware configuration; a common configuration is spread over tasks."""
    groups = hardware_groups(machines, position).select("hwconfig", "code")
    return keyed_join(hardware_members(machines), groups, ["hwconfig"]).select("hostname", "code")


def members_with_samples(members: DataFrame, samples: DataFrame, host: str = "host") -> DataFrame:
    """Members that have at least one sample."""
    return members.join(
        samples.select(F.col(host).alias("hostname")), "hostname", "left_semi"
    )


def default_subset(members: DataFrame) -> DataFrame:
    """One machine per hardware configuration, the first by name."""
    return members.groupBy("hwconfig").agg(F.min("hostname").alias("hostname")).select("hostname")
