"""Extended nets: what a net reaches through passive parts.

A traversal from a start net expands the start and every other net that is no power or ground. Expanding a net
shows the pins on it; a passive part on it also shows its other pins, and their nets are visited. Parts that are
skipped (do-not-stuff unless wanted, then by prefix) show nothing and forward nothing.

Two plans give this. ``reach`` moves a frontier hop by hop, for any set of starts. ``closures`` labels the
connected components of the passive graph once, by star contraction; the extended net of a start that is no stop net is its label.
Both go through the bipartite net - part graph, so a part with many pins costs its pins and not their square.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators.components import described_net_pins
from copperline.operators.contraction import key_labels
from copperline.plans.netlist import Netlist, with_dns

MAX_HOPS = 100_000
#: Rows of a frontier, and of what it meets, that are broadcast; wider ones are merged with the tables.
NARROW = 100_000


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; only on a local master a temporary one stands in."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not root:
            import tempfile

            root = "file://" + tempfile.mkdtemp(prefix="copperline-")
        sc.setCheckpointDir(root)
    return re.sub("^file:/+", "file:///", sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a table of the shared folder.

    A checkpoint keeps the estimated size of the plan that made it; joined round after round these estimates are multiplied,
    to numbers that fill the driver. It also writes whole rows uncompressed, where later steps read a few columns. Files are
    small for their rows, so joins with the table are merges unless they ask for a broadcast: millions of rows of a few MB
    would go through the driver.
    """
    path = f"{shared_root(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def allowed_components(netlist: Netlist, skip_types: list[str] = (), include_dns: bool = False) -> DataFrame:
    """(design_id, refdes) of the component rows that are not skipped."""
    rows = with_dns(netlist.components)
    keep = exprs.skip_match(F.col("refdes"), list(skip_types)).isNull()
    if not include_dns:
        keep = keep & ~F.col("dns")
    return rows.where(keep).select("design_id", "refdes")


def passive_pins(netlist: Netlist, skip_types: list[str] = (), include_dns: bool = False) -> DataFrame:
    """(design_id, refdes, pin, net): component pins of the passives that forward a traversal."""
    passive = exprs.is_passive(F.col("refdes"))  # told by the name, on both sides before they are dealt
    allowed = allowed_components(netlist, skip_types, include_dns).where(passive)
    return netlist.component_pins.where(passive).join(allowed, ["design_id", "refdes"], "left_semi").select("design_id", "refdes", "pin", "net")


def starts_of(spark: SparkSession, design_nets: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(design_nets, "design_id string, net string").select("design_id", F.col("net").alias("root"))


def reach(netlist: Netlist, starts: DataFrame, skip_types: list[str] = (), include_dns: bool = False) -> DataFrame:
    """(design_id, root, net, hop, expanded): every net that a traversal from each start visits.

    ``starts`` has design_id and root; starts that are no net visit nothing.
    """
    ends = cut(passive_pins(netlist, skip_types, include_dns).select("design_id", "refdes", F.col("net").alias("to")).distinct())
    on_nets = netlist.net_pins.where(exprs.is_passive(F.col("refdes"))).select("design_id", "net", "refdes")
    touch = cut(on_nets.join(ends.select("design_id", "refdes"), ["design_id", "refdes"], "left_semi").distinct())
    exists = netlist.nets.select("design_id", F.col("net").alias("root"))
    seen = cut(starts.select("design_id", "root").distinct().join(exists, ["design_id", "root"], "left_semi").select("design_id", "root", F.col("root").alias("net"), F.lit(0).alias("hop"), F.lit(True).alias("expanded")))
    frontier, n, found = seen, seen.count(), None
    for hop in range(1, MAX_HOPS):
        new = _next_nets(frontier.where("expanded").select("design_id", "root", "net"), n, touch, ends, found)
        frontier = cut(new.select("design_id", "root", "net", F.lit(hop).alias("hop"), (~exprs.is_stop(F.col("net"))).alias("expanded")))
        n = frontier.count()
        if not n:
            return seen.unionByName(found) if found else seen
        found = found.unionByName(frontier) if found else frontier
        if hop % 16 == 0:
            found = cut(found)
    raise RuntimeError("the traversal did not end")


def _next_nets(frontier: DataFrame, n: int, touch: DataFrame, ends: DataFrame, found: DataFrame | None) -> DataFrame:
    """(design_id, root, net) that a frontier of up to ``n`` rows reaches in a hop, without the roots themselves and those that earlier hops found.

    A narrow frontier goes to the tables, which are scanned and not dealt. What it meets is stored and counted before it goes on,
    as a hub may make it wide at any step.
    """
    key = ["design_id", "root", "net"]
    end = F.col("to").alias("net")
    away = F.col("to") != F.col("root")
    if n > NARROW:
        met = frontier.join(touch, ["design_id", "net"]).select("design_id", "root", "refdes").distinct()
        near = met.join(ends, ["design_id", "refdes"]).where(away).select("design_id", "root", end).distinct()
        return near.join(found.select(key), key, "left_anti") if found else near
    met = cut(touch.join(F.broadcast(frontier), ["design_id", "net"]).select("design_id", "root", "refdes").distinct())
    near = cut(ends.join(F.broadcast(met) if met.count() <= NARROW else met, ["design_id", "refdes"]).where(away).select("design_id", "root", end).distinct())
    if not found:
        return near
    if near.count() > NARROW:
        return near.join(found.select(key), key, "left_anti")
    known = found.select(key).join(F.broadcast(near), key, "left_semi")  # no more rows than near ones
    return near.join(F.broadcast(known), key, "left_anti")


def circuit_pins(netlist: Netlist, visited: DataFrame, skip_types: list[str] = (), include_dns: bool = False) -> DataFrame:
    """The pins that traversals show: design_id, root, refdes, pin, net, hop, and what is known of the component.

    A pin that both its net and its component name shows once, on the net that comes first.
    """
    nets = visited.where("expanded").select("design_id", "root", "net", "hop")
    described = described_net_pins(netlist)
    keep = exprs.skip_match(F.col("refdes"), list(skip_types)).isNull()
    if not include_dns:
        keep = keep & ~F.col("dns")
    about = ["mpn", "mpn_present", "description", "comment", "value", "dns"]
    on_nets = described.where(keep).join(nets, ["design_id", "net"]).select("design_id", "root", "refdes", "pin", "net", (F.col("hop") * 2).alias("hop"), *about)
    touched = on_nets.where(exprs.is_passive(F.col("refdes"))).groupBy("design_id", "root", "refdes").agg(F.min("hop").alias("hop"), *[F.first(c).alias(c) for c in about])
    others = touched.join(passive_pins(netlist, skip_types, include_dns), ["design_id", "refdes"]).select("design_id", "root", "refdes", "pin", "net", (F.col("hop") + 1).alias("hop"), *about)
    first = F.row_number().over(Window.partitionBy("design_id", "root", "refdes", "pin").orderBy("hop", "net"))
    # The parts of circuits are dealt once: windows and groups by keys that hold these three find their rows together.
    rows = on_nets.unionByName(others).repartition("design_id", "root", "refdes").withColumn("n", first).where("n = 1").drop("n")
    return rows.withColumn("dns", F.when(F.col("dns"), True))


def skipped_counts(netlist: Netlist, visited: DataFrame, skip_types: list[str], include_dns: bool = False) -> DataFrame:
    """(design_id, root, skip_type, n): parts on expanded nets that each type left out. Do-not-stuff parts don't count."""
    nets = visited.where("expanded").select("design_id", "root", "net")
    rows = described_net_pins(netlist).withColumn("skip_type", exprs.skip_match(F.col("refdes"), list(skip_types)))
    rows = rows.where(F.col("skip_type").isNotNull() & (F.lit(include_dns) | ~F.col("dns")))
    return rows.join(nets, ["design_id", "net"]).groupBy("design_id", "root", "skip_type").agg(F.count_distinct("refdes").alias("n"))


def closures(netlist: Netlist, skip_types: list[str] = (), include_dns: bool = False) -> DataFrame:
    """(design_id, net, label): nets that are no stop nets, labelled by the least net name of their extended net."""
    nets = netlist.nets.where(~exprs.is_stop(F.col("net"))).select("design_id", "net")
    steps = passive_pins(netlist, skip_types, include_dns).select("design_id", "refdes", "net").join(nets, ["design_id", "net"], "left_semi")
    # A part links each of its nets with the least of them, so links number its pins and nets alone are nodes.
    least = F.min("net").over(Window.partitionBy("design_id", "refdes"))
    found = key_labels(steps.select("design_id", F.col("net").alias("a"), least.alias("b")), ["design_id"], cut).withColumnRenamed("node", "net")
    return nets.join(found, ["design_id", "net"], "left").select("design_id", "net", F.coalesce("label", "net").alias("label"))


def closure_visits(labels: DataFrame) -> DataFrame:
    """Visited rows, in the form of ``reach``, of every extended net: the root is its label."""
    return labels.select("design_id", F.col("label").alias("root"), "net", F.when(F.col("label") == F.col("net"), 0).otherwise(1).alias("hop"), F.lit(True).alias("expanded"))
