"""Answers for one design as plain dictionaries: the thin edge over the operators.

Errors and notes are part of the answer. Lists with one element collapse to it where answers are compact; fields
that are not known are left out, while a part number that is known to be missing is null.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators import components as parts
from copperline.operators import answers, grouping, xnet
from copperline.operators.components import InvalidPattern
from copperline.plans.netlist import Netlist
from copperline.sources import formats
from copperline.sources.formats import DesignError
from copperline.sources.listing import normal_path
from copperline.sources.ole import OleError

# Texts that users of these answers know.
NO_MPN = "This netlist has no MPN data. Ask user for BOM or schematic PDF"
NO_DESCRIPTION = "This netlist has no description data. Ask user for BOM or schematic PDF"
BROADER = "No components matched pattern '{}'. Try a broader pattern or use search_components_by_refdes instead"
MANUAL = "Manual export: Open Cadence, then: Tools → Create Netlist → PCB Editor format."
WINDOWS_ONLY = f"Cadence export tools are only available on Windows. The pstswp utility requires a Windows environment with Cadence SPB installed. {MANUAL}"


def render(answer: object) -> str:
    """An answer as indented JSON."""
    return json.dumps(answer, indent=2, ensure_ascii=False)


def is_error(answer: object) -> bool:
    return isinstance(answer, dict) and isinstance(answer.get("error"), str)


def _answers(f: Callable) -> Callable:
    @wraps(f)
    def run(*args, **kwargs):
        try:
            return f(*args, **kwargs)
        except InvalidPattern as e:
            return {"error": f"Invalid regex pattern '{e}'"}
        except DesignError as e:
            return {"error": str(e)}
        except Exception as e:  # a file that can't be read fails in a task; its own message is the answer
            if isinstance(e, OSError | OleError):
                return {"error": str(e)}
            found = re.search(r"OleError: (?:.*?: )?(.+)", str(e))
            if found:
                return {"error": found[1]}
            raise

    return run


def design_name(path: str) -> str:
    return posixpath.splitext(posixpath.basename(normal_path(path)))[0]


def open_design(spark: SparkSession, design: str | Netlist) -> Netlist:
    """A design's tables; a Netlist passes, so that several questions can share one load."""
    return design if isinstance(design, Netlist) else formats.load(spark, [design])


def _name(design: str | Netlist) -> str:
    return design_name(design) if isinstance(design, str) else "design"


def compact(values: list) -> object:
    return values[0] if len(values) == 1 else values


def _group(row: Row) -> dict:
    out = {"mpn": row.mpn, "count": row["count"], "refdes": compact(row.refdes)}
    return out | {k: row[k] for k in ("description", "comment", "value", "dns", "notes") if row[k] is not None}


def _groups(rows) -> list[dict]:
    return [_group(r) for r in rows.orderBy(*grouping.group_order()).collect()]


@_answers
def list_designs(spark: SparkSession, path: str | None = None, pattern: str = ".*") -> list[dict] | dict:
    java = _pattern(spark, pattern)
    rows = formats.discover(spark, normal_path(path or os.getcwd())).where(F.col("name").rlike(java)).collect()
    return [{"name": r.name, "path": r.path} | ({"error": r.error} if r.error else {}) for r in rows]


def _pattern(spark: SparkSession, pattern: str) -> str:
    try:
        return parts.checked_pattern(spark, pattern)
    except InvalidPattern:
        raise InvalidPattern(pattern) from None


@_answers
def list_components(spark: SparkSession, design: str | Netlist, kind: str, include_dns: bool = False) -> dict:
    netlist = open_design(spark, design)
    prefix = kind.strip().upper()
    if not prefix:
        return {"error": "Missing required parameter: type"}
    if netlist.components.where(exprs.has_prefix(F.col("refdes"), prefix)).isEmpty():
        known = [r.prefix for r in parts.available_prefixes(netlist).orderBy(exprs.collated(F.col("prefix"))).collect()]
        return {"error": f"No components with prefix '{prefix}' found in design '{_name(design)}'. Available prefixes: [{', '.join(known)}]"}
    return {"components": _groups(parts.list_components(netlist, prefix, include_dns))}


@_answers
def list_nets(spark: SparkSession, design: str | Netlist) -> dict:
    return {"nets": [r.net for r in parts.list_nets(open_design(spark, design)).orderBy(*parts.net_order()).collect()]}


@_answers
def search_nets(spark: SparkSession, pattern: str, design: str | Netlist) -> dict:
    java = _pattern(spark, pattern)
    nets = [r.net for r in parts.search_nets(open_design(spark, design), java).orderBy(*parts.net_order()).collect()]
    return {"results": {_name(design): nets}} | ({} if nets else {"notes": [f"No nets matched pattern '{pattern}'"]})


def _found(design: str | Netlist, groups: list[dict], note: str) -> dict:
    return {"results": {_name(design): groups}} | ({} if groups else {"notes": [note]})


@_answers
def search_components_by_refdes(spark: SparkSession, pattern: str, design: str | Netlist, include_dns: bool = False) -> dict:
    java = _pattern(spark, pattern)
    return _found(design, _groups(parts.search_by_refdes(open_design(spark, design), java, include_dns)), f"No components matched refdes pattern '{pattern}'")


@_answers
def search_components_by_mpn(spark: SparkSession, pattern: str, design: str | Netlist, include_dns: bool = False) -> dict:
    java, netlist = _pattern(spark, pattern), open_design(spark, design)
    groups = _groups(parts.search_by_mpn(netlist, java, include_dns))
    return _found(design, groups, BROADER.format(pattern) if groups or parts.has_filled(netlist, "mpn") else NO_MPN)


@_answers
def search_components_by_description(spark: SparkSession, pattern: str, design: str | Netlist, include_dns: bool = False) -> dict:
    java, netlist = _pattern(spark, pattern), open_design(spark, design)
    groups = _groups(parts.search_by_description(netlist, java, include_dns))
    return _found(design, groups, BROADER.format(pattern) if groups or parts.has_filled(netlist, "description") else NO_DESCRIPTION)


def _unknown_component(design: str | Netlist, refdes: str) -> dict:
    return {"error": f"Component '{refdes}' not found in design '{_name(design)}'. Use list_components() or search_components_by_refdes() to find available components."}


@_answers
def query_component(spark: SparkSession, design: str | Netlist, refdes: str) -> dict:
    netlist = open_design(spark, design)
    found = parts.find_component(netlist, refdes).first()
    if found is None:
        return _unknown_component(design, refdes)
    row = parts.component_details(netlist).where(F.col("refdes") == found.refdes).first()
    out = {"refdes": row.refdes, "mpn": row.mpn, "pins": {p.pin: p.net if p.name is None else {"name": p.name, "net": p.net} for p in row.pins}}
    return out | {k: row[k] for k in ("description", "comment", "value", "dns", "notes") if row[k] is not None}


def circuit(spark: SparkSession, netlist: Netlist, start: str, skip_types: list[str] = (), include_dns: bool = False) -> dict:
    """What a traversal from a net shows, rolled up."""
    design = netlist.nets.select("design_id").first().design_id
    rows = answers.circuits(netlist, xnet.starts_of(spark, [(design, start)]), skip_types, include_dns).collect()  # one answer
    told = lambda kind: [json.loads(r.body) for r in sorted((r for r in rows if r.kind == kind), key=lambda r: r.place)]
    totals = next(iter(told("totals")), {"total_components": 0, "unique_configurations": 0, "circuit_hash": grouping.EMPTY_HASH})
    digest = totals.pop("circuit_hash")
    out = totals | {"components_by_mpn": told("group"), "visited_nets": told("visited"), "circuit_hash": digest}
    skipped = {r["skip_type"]: r["n"] for r in told("skipped")}
    return out | ({"skipped": skipped} if skipped else {})


@_answers
def query_xnet_by_net_name(spark: SparkSession, design: str | Netlist, net: str, skip_types: list[str] = (), include_dns: bool = False) -> dict:
    netlist = open_design(spark, design)
    row = netlist.nets.where(F.col("net") == net).select(exprs.is_ground(F.col("net")).alias("ground")).first()
    if row is None:
        return {"error": f"Net '{net}' not found in design '{_name(design)}'. Use search_nets() to find available nets."}
    if row.ground:
        return {"error": f"{net} is a ground net and cannot be queried."}
    return {"starting_point": net} | circuit(spark, netlist, net, skip_types, include_dns)


@_answers
def query_xnet_by_pin_name(spark: SparkSession, design: str | Netlist, pin: str, skip_types: list[str] = (), include_dns: bool = False) -> dict:
    netlist = open_design(spark, design)
    if pin.count(".") != 1:
        return {"error": f"Invalid pin name '{pin}'. Expected 'REFDES.PIN'."}
    refdes, number = pin.split(".")
    owner = parts.find_component(netlist, refdes).first()
    if owner is None:
        return _unknown_component(design, refdes)
    row = parts.find_pin(netlist, refdes, number).withColumn("ground", exprs.is_ground(F.col("net"))).first()
    if row is None:
        pins = netlist.component_pins.where(F.col("refdes") == owner.refdes).agg(exprs.naturally_sorted(F.collect_list("pin")).alias("pins")).first().pins
        return {"error": f"Pin '{pin}' not found. Component {owner.refdes} has pins: [{', '.join(pins)}]"}
    start = f"{row.refdes}.{row.pin}"
    if row.ground:
        return {"error": f"Pin {start} is connected to {row.net} (ground) and cannot be queried."}
    if row.net == exprs.NOT_CONNECTED:
        return {"starting_point": start, "net": row.net, "total_components": 0, "unique_configurations": 0, "components_by_mpn": [], "visited_nets": [row.net], "circuit_hash": f"nc-{start}"}
    if netlist.nets.isEmpty():
        return {"starting_point": start, "net": row.net, "total_components": 0, "unique_configurations": 0, "components_by_mpn": [], "visited_nets": [], "circuit_hash": grouping.EMPTY_HASH}
    return {"starting_point": start, "net": row.net} | circuit(spark, netlist, row.net, skip_types, include_dns)


def detect_cadence_versions(base: str = "C:/Cadence") -> list[dict]:
    """Installed releases, the latest first."""
    found = []
    for name in os.listdir(base) if os.path.isdir(base) else ():
        version = re.fullmatch(r"SPB_(\d+\.\d+)", name)
        root = posixpath.join(base, name)
        tool, config = posixpath.join(root, "tools", "bin", "pstswp.exe"), posixpath.join(root, "tools", "capture", "allegro.cfg")
        if version and os.path.exists(tool) and os.path.exists(config):
            found.append({"version": version[1], "root": root, "pstswp": tool, "config": config})
    return sorted(found, key=lambda x: -float(x["version"]))


def latest_cadence(base: str = "C:/Cadence") -> dict | None:
    return next(iter(detect_cadence_versions(base)), None)


def bash_path(path: str) -> str:
    """C:\\a\\b as /c/a/b."""
    return re.sub(r"^([A-Za-z]):", lambda m: f"/{m[1].lower()}", path.replace("\\", "/"))


def export_cadence_netlist(dsn: str) -> dict:
    """Only a Windows machine with the vendor's tools can export; here the answer says so. Nothing is run."""
    if sys.platform != "win32":
        return {"error": WINDOWS_ONLY}
    return {"error": f"No Cadence SPB installation found in C:/Cadence. Ensure Cadence Design Entry CIS or HDL is installed. {MANUAL}"}
