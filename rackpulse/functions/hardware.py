"""Hardware-detail text to arrays: document split and node extraction.

One Python step reads each document into a flat list of its nodes. The XPath
functions of SQL were tried first; they build a parser per call, and the twenty
calls a machine needs took about a millisecond each.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from rackpulse.functions.status import as_column, bind

# Vendors of on-board graphics that are no accelerators.
NOT_ACCELERATORS = ("Matrox", "ASPEED")

# Operations per cycle and hertz per unit of compute.
OPS_PER_CYCLE = 16
HERTZ_PER_UNIT = 10**9

_TEXT = T.StringType()
_NODE_TEXTS = ("id", "class", "vendor", "product", "size", "size_units", "capacity", "capacity_units")
NODES = T.ArrayType(T.StructType(
    [T.StructField(name, _TEXT) for name in _NODE_TEXTS]
    + [T.StructField(name, T.ArrayType(_TEXT)) for name in ("cores", "threads")]
))
NEIGHBOURS = T.ArrayType(T.StructType([T.StructField(name, _TEXT) for name in ("interface", "mac", "vlan")]))


def details_document(text: Column | str, tag: str) -> Column:
    """The neighbour document (``lldp``) or the hardware document (``list``) of a details text.

    Two XML documents follow each other in either order. Each one ends at its
    first end tag or, where it has none, at the last self-closed tag.
    """
    def segment(t: Column) -> Column:
        first = F.regexp_extract(t, r"(?s)(<\?xml.*)<\?xml", 1)
        second = F.regexp_extract(t, r"(?s)^.*(<\?xml.*)$", 1)
        lldp_first = F.locate("<lldp", t) < F.locate("<list", t)
        return F.when(lldp_first, first if tag == "lldp" else second).otherwise(second if tag == "lldp" else first)

    def document(s: Column) -> Column:
        full = F.regexp_extract(s, rf"(?s)^(.*?</{tag}>)", 1)
        closed = F.regexp_extract(s, r"(?s)^(.*/>)", 1)
        return F.when(F.length(full) > 0, full).otherwise(closed)

    return bind(bind(as_column(text), segment), document)


def split_details(text: Column | str) -> Column:
    """Struct with the neighbour document and the hardware document of a details text."""
    return F.struct(details_document(text, "lldp").alias("lldp"), details_document(text, "list").alias("hardware"))


def _root(document: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(document) if document else None
    except ET.ParseError:
        return None


def _settings(node: ET.Element, prefix: str) -> list[str]:
    return [s.get("value") for s in node.iter("setting") if s.get("id", "").startswith(prefix)]


def _node_row(node: ET.Element) -> dict:
    size, capacity = node.find("size"), node.find("capacity")
    is_cpu = node.get("class") == "processor"
    return {
        "id": node.get("id", ""), "class": node.get("class"),
        "vendor": node.findtext("vendor"), "product": node.findtext("product"),
        "size": None if size is None else size.text, "size_units": None if size is None else size.get("units"),
        "capacity": None if capacity is None else capacity.text,
        "capacity_units": None if capacity is None else capacity.get("units"),
        "cores": _settings(node, "cores") if is_cpu else [],
        "threads": _settings(node, "threads") if is_cpu else [],
    }


@pandas_udf(NODES)
def _read_nodes(documents: pd.Series) -> pd.Series:
    roots = documents.map(_root)
    return roots.map(lambda root: None if root is None else [_node_row(n) for n in root.iter("node")])


def hardware_nodes(document: Column) -> Column:
    """All nodes of a hardware document in document order; null when it cannot be read.

    Declared nondeterministic so that a filter on the result does not make Spark
    read the document a second time.
    """
    return _read_nodes.asNondeterministic()(document)


@pandas_udf(NEIGHBOURS)
def neighbours_of(documents: pd.Series) -> pd.Series:
    """Interface, chassis id and vlan of each neighbour in each neighbour document."""
    def links(root: ET.Element | None) -> list[dict]:
        if root is None:
            return []
        rows = [
            {"interface": i.get("name"), "mac": i.findtext("chassis/id"),
             "vlan": None if i.find("vlan") is None else i.find("vlan").get("vlan-id")}
            for i in root.iter("interface")
        ]
        return [r for r in rows if all(r.values())]

    return documents.map(_root).map(links)


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _longs(values: Column) -> Column:
    return F.transform(values, lambda v: v.cast("bigint"))


def _total(lists: Column) -> Column:
    return F.aggregate(_longs(F.flatten(lists)), F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def _is_cpu(n: Column) -> Column:
    return (n["class"] == "processor") & n["id"].contains("cpu:")


def _is_bank(n: Column) -> Column:
    return (n["class"] == "memory") & n["id"].contains("bank:")


def system_of(nodes: Column) -> Column:
    """Vendor and product of the system node; the last one wins."""
    system = _last(F.filter(nodes, lambda n: n["class"] == "system"))
    return F.struct(system["vendor"].alias("vendor"), system["product"].alias("product"))


def processors_of(nodes: Column) -> Column:
    """Core and thread totals, compute figure, vendor and product list."""
    cpus = F.filter(nodes, _is_cpu)
    sized = F.filter(cpus, lambda n: n["size"].isNotNull())
    named = F.filter(cpus, lambda n: n["vendor"].isNotNull())
    threads = _total(F.transform(sized, lambda n: n["threads"]))
    hertz = _last(sized)["size"].cast("double")
    return F.struct(
        _total(F.transform(sized, lambda n: n["cores"])).alias("cores"), threads.alias("threads"),
        (threads * (hertz / HERTZ_PER_UNIT) * OPS_PER_CYCLE).alias("mflops"),
        _last(named)["vendor"].alias("vendor"), F.transform(named, lambda n: n["product"]).alias("products"),
    )


def memory_of(nodes: Column) -> Column:
    banks = F.filter(nodes, lambda n: _is_bank(n) & n["size"].isNotNull())
    return _longs(F.transform(banks, lambda n: n["size"]))


def power_supplies_of(nodes: Column) -> Column:
    supplies = F.filter(nodes, lambda n: (n["class"] == "power") & n["capacity"].isNotNull())
    return _longs(F.transform(supplies, lambda n: n["capacity"]))


def _named(nodes: Column, part: str) -> Column:
    return F.filter(
        nodes, lambda n: n["id"].contains(part) & n["vendor"].isNotNull() & n["product"].isNotNull()
    )


def disks_of(nodes: Column) -> Column:
    """Disks that name size, vendor and product."""
    disks = F.filter(_named(nodes, "disk"), lambda n: n["size"].isNotNull())
    return F.transform(disks, lambda n: F.struct(
        n["vendor"].alias("vendor"), n["product"].alias("product"), n["size"].cast("bigint").alias("size")
    ))


def nics_of(nodes: Column) -> Column:
    return F.transform(_named(nodes, "network"), lambda n: F.struct(
        n["vendor"].alias("vendor"), n["product"].alias("product")
    ))


def accelerators_of(nodes: Column, gpu_units: dict[str, int]) -> Column:
    """Display nodes that are no on-board graphics, with their compute figure (0 if unlisted)."""
    units = F.create_map(*(F.lit(x) for pair in gpu_units.items() for x in pair))
    kept = F.filter(_named(nodes, "display"), lambda n: ~n["vendor"].rlike("|".join(NOT_ACCELERATORS)))
    return F.transform(kept, lambda n: F.struct(
        n["vendor"].alias("vendor"), n["product"].alias("product"),
        F.coalesce(F.try_element_at(units, n["product"]), F.lit(0)).cast("bigint").alias("mflops"),
    ))


def document_error(nodes: Column) -> Column:
    """Why a hardware document must be rejected, or null."""
    def other_unit(n: Column, field: str, unit: str) -> Column:
        return n[field].isNotNull() & F.coalesce(n[f"{field}_units"] != unit, F.lit(True))

    return (
        F.when(nodes.isNull(), "document not readable")
        .when(F.exists(nodes, lambda n: _is_bank(n) & other_unit(n, "size", "bytes")), "memory size not in bytes")
        .when(
            F.exists(nodes, lambda n: (n["class"] == "power") & other_unit(n, "capacity", "mWh")),
            "power capacity not in mWh",
        )
        .when(
            F.exists(nodes, lambda n: n["id"].contains("disk") & other_unit(n, "size", "bytes")),
            "disk size not in bytes",
        )
    )
