"""Listing, searching and looking up components and nets, over one design or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.functions.patterns import InvalidPattern, java_pattern
from copperline.operators.grouping import group_by_mpn
from copperline.plans.netlist import Netlist, with_dns


def checked_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for Java's engine; raises InvalidPattern for one that does not compile."""
    java = java_pattern(pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise InvalidPattern(pattern) from e
    return java


def list_nets(netlist: Netlist) -> DataFrame:
    return netlist.nets.select("design_id", "net").distinct()


def net_order() -> list[Column]:
    return [F.col("design_id"), exprs.collated(F.col("net")), F.col("net")]


def search_nets(netlist: Netlist, pattern: str) -> DataFrame:
    """Nets whose name has a match, with case."""
    return list_nets(netlist).where(F.col("net").rlike(pattern))


def list_components(netlist: Netlist, kind: str, include_dns: bool = False) -> DataFrame:
    """Grouped components whose refdes starts with ``kind``, in any case."""
    return group_by_mpn(netlist.components.where(exprs.has_prefix(F.col("refdes"), kind.strip())), include_dns)


def available_prefixes(netlist: Netlist) -> DataFrame:
    valid = netlist.components.where(exprs.is_refdes(F.col("refdes")))
    return valid.select("design_id", exprs.refdes_prefix(F.col("refdes")).alias("prefix")).distinct()


def _search(netlist: Netlist, column: str, pattern: str, include_dns: bool) -> DataFrame:
    return group_by_mpn(netlist.components.where(exprs.filled(F.col(column)).isNotNull() & F.col(column).rlike("(?iu)" + pattern)), include_dns)


def search_by_refdes(netlist: Netlist, pattern: str, include_dns: bool = False) -> DataFrame:
    return group_by_mpn(netlist.components.where(F.col("refdes").rlike("(?iu)" + pattern)), include_dns)


def search_by_mpn(netlist: Netlist, pattern: str, include_dns: bool = False) -> DataFrame:
    return _search(netlist, "mpn", pattern, include_dns)


def search_by_description(netlist: Netlist, pattern: str, include_dns: bool = False) -> DataFrame:
    return _search(netlist, "description", pattern, include_dns)


def has_filled(netlist: Netlist, column: str) -> bool:
    """Whether any component has a text there that is not blank."""
    return not netlist.components.where(exprs.filled(F.col(column)).isNotNull()).isEmpty()


def find_component(netlist: Netlist, refdes: str) -> DataFrame:
    """The first component of each design with this refdes, in any case."""
    rows = netlist.components.where(F.lower("refdes") == refdes.strip().lower())
    first = F.row_number().over(Window.partitionBy("design_id").orderBy("comp_ord"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def find_pin(netlist: Netlist, refdes: str, pin: str) -> DataFrame:
    """The first pin of that component with this number, in any case: design_id, refdes, pin, net."""
    owner = find_component(netlist, refdes).select("design_id", "refdes")
    rows = netlist.component_pins.where(F.lower("pin") == pin.strip().lower()).join(owner, ["design_id", "refdes"])
    order = exprs.map_order(F.col("pin"), F.col("pin_ord"))
    first = F.row_number().over(Window.partitionBy("design_id").orderBy(order))
    return rows.withColumn("n", first).where("n = 1").select("design_id", "refdes", "pin", "net")


def component_details(netlist: Netlist) -> DataFrame:
    """Every component as an answer shows it, with its pins in key order: (pin, name, net)."""
    order = exprs.map_order(F.col("pin"), F.col("pin_ord"))
    pins = netlist.component_pins.groupBy("design_id", "refdes").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("k"), "pin", F.col("pin_name").alias("name"), "net"))), lambda s: F.struct(s["pin"].alias("pin"), s["name"].alias("name"), s["net"].alias("net"))).alias("pins"))
    mpn = exprs.filled(F.col("mpn"))
    rows = with_dns(netlist.components).join(pins, ["design_id", "refdes"], "left")
    notes = F.when(mpn.isNull(), F.array(F.lit(exprs.MPN_MISSING_NOTE)))
    return rows.select("design_id", "refdes", mpn.alias("mpn"), "description", "comment", "value", F.when(F.col("dns"), True).alias("dns"), notes.alias("notes"), F.coalesce("pins", F.array().cast("array<struct<pin:string,name:string,net:string>>")).alias("pins"), "comp_ord")


def described_net_pins(netlist: Netlist) -> DataFrame:
    """Net pins with what is known of their components; parts without a row keep nulls."""
    about = with_dns(netlist.components).select("design_id", "refdes", "mpn", "mpn_present", "description", "comment", "value", "dns")
    return netlist.net_pins.join(about, ["design_id", "refdes"], "left").withColumn("dns", F.coalesce("dns", F.lit(False)))
