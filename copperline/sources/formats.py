"""The registry of design formats, and loading designs of any of them into one netlist."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline.functions.exprs import collated
from copperline.plans.netlist import Netlist
from copperline.sources import altium, cadence, listing
from copperline.sources.listing import extension, normal_path


class DesignError(ValueError):
    """A design that can't be loaded; the text is what users see."""


@dataclass(frozen=True)
class Format:
    """A kind of project: discover gives (name, format, path, error, ...) rows of a listing, load the netlist of given designs."""

    name: str
    extensions: tuple[str, ...]
    discover: Callable[[DataFrame], DataFrame]
    load: Callable[[SparkSession, list[str]], Netlist]

    def handles(self, path: str) -> bool:
        return extension(path) in self.extensions


def _named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The given design files as rows of a listing."""
    return spark.createDataFrame([(p, posixpath.dirname(p), posixpath.basename(p), posixpath.splitext(posixpath.basename(p))[0], extension(p)) for p in paths], listing.LISTING)


def _load_cadence(spark: SparkSession, paths: list[str]) -> Netlist:
    """Each design with the best data set below its own folder: one listing and one join for all designs."""
    files = listing.listing(spark, *{posixpath.dirname(p) for p in paths})
    best = {r.path: r for r in listing.best_dat_set(files, _named(spark, paths)).collect()}  # a row for each path that was asked for
    for path in paths:
        if path not in best:
            raise DesignError(f"Missing netlist files for {posixpath.basename(path)}. Run export_cadence_netlist to generate them.")
    rows = [(path, kind, r[kind]) for path, r in best.items() for kind in ("pstxnet", "pstxprt", "pstchip")]
    wanted = spark.createDataFrame(rows, "design_id string, kind string, path string")
    return cadence.split_netlist(wanted)


def _load_altium(spark: SparkSession, paths: list[str]) -> Netlist:
    """Each project with its sheets: one listing and one join for all projects."""
    files = listing.listing(spark, *{posixpath.dirname(p) for p in paths}).where(~F.col("ext").isin(listing.ALTIUM_EXTENSIONS))
    found = {r.path: r.sheets for r in listing.altium_designs(files.union(_named(spark, paths))).collect()}  # a row for each path
    for path in paths:
        if not found.get(path):
            raise DesignError(f"No schematic documents found for project {path}")
    rows = [(path, sheet, k) for path, sheets in found.items() for k, sheet in enumerate(sheets)]
    wanted = spark.createDataFrame(rows, "design_id string, sheet string, sheet_ord int")
    return altium.file_netlist(wanted.repartition(min(len(rows), 1 << 12), "sheet"))


FORMATS = [
    Format("cadence", tuple(listing.CADENCE_EXTENSIONS), listing.cadence_designs, _load_cadence),
    Format("altium", tuple(listing.ALTIUM_EXTENSIONS), listing.altium_designs, _load_altium),
]


def supported_extensions() -> list[str]:
    return [e for f in FORMATS for e in f.extensions]


def find_format(path: str) -> Format | None:
    return next((f for f in FORMATS if f.handles(path)), None)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(name, format, path, error) of all designs below root, in collated order of their names."""
    files = listing.listing(spark, root)
    found = [f.discover(files).select("name", "format", "path", "error") for f in FORMATS]
    return reduce(DataFrame.unionByName, found).orderBy(collated(F.col("name")), "path")


def load(spark: SparkSession, paths: list[str]) -> Netlist:
    """The netlist of designs of one or more formats; design_id is the path. Unconnected pins name NC."""
    by_format: dict[str, list[str]] = {}
    for path in map(normal_path, paths):
        kind = find_format(path)
        if kind is None:
            raise DesignError(f"Unsupported design file format '{posixpath.splitext(path)[1]}'. Supported: .dsn, .cpm (Cadence), .PrjPcb (Altium)")
        by_format.setdefault(kind.name, []).append(path)
    loaded = [next(f for f in FORMATS if f.name == name).load(spark, own) for name, own in by_format.items()]
    merged = Netlist(*(reduce(DataFrame.unionByName, [getattr(n, t) for n in loaded]) for t in ("components", "component_pins", "net_pins", "nets")))
    return merged.normalised()
