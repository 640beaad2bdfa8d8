"""The supplied star schema seen as one netlist: parts are components, line items their pins, orders the nets."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperline.operators import xnet
from copperline.operators.ordering import numbered
from copperline.plans.netlist import Netlist

DESIGN = "star"
#: Part type to refdes prefix; the others are J. The first four are passive.
PREFIXES = {"ECONOMY": "R", "SMALL": "C", "MEDIUM": "L", "PROMO": "FB", "LARGE": "U"}
ACTIVE_PINS = 8
#: Lines of a block of a text export.
BLOCK_LINES = 50_000


def refdes_of(kind, key):
    prefix = F.lit("J")
    for name, letter in PREFIXES.items():
        prefix = F.when(kind == name, letter).otherwise(prefix)
    return F.concat(prefix, key.cast("string"))


def net_of(order):
    return F.when(order % 97 == 0, "GND").when(order % 89 == 0, "+3V3").otherwise(F.concat(F.lit("N"), order.cast("string")))


def netlist(spark: SparkSession, sf_dir: str) -> Netlist:
    """Passives have pin 1 on their cheapest line's order and pin 2 on their dearest one's, actives up to eight pins."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, size = F.col("p_partkey"), F.col("p_size")
    components = part.select(
        F.lit(DESIGN).alias("design_id"),
        refdes_of(F.col("p_type"), key).alias("refdes"),
        F.when(size % 10 != 0, F.concat("p_brand", F.lit("-"), size.cast("string"))).alias("mpn"),
        F.lit(True).alias("mpn_present"),
        F.concat("p_name", F.when(key % 17 == 0, " DNP").otherwise("")).alias("description"),
        F.lit(None).cast("string").alias("comment"),
        size.cast("string").alias("value"),
        key.cast("long").alias("comp_ord"),
    )
    pins = ranked_pins(spark, sf_dir, part)
    component_pins = pins.select("design_id", "refdes", "pin", F.lit(None).cast("string").alias("pin_name"), "net", F.col("pin").cast("long").alias("pin_ord"))
    order = F.col("l_orderkey").cast("long")
    net_pins = pins.select("design_id", "net", "refdes", "pin", order.alias("net_ord"), F.col("l_partkey").cast("long").alias("ref_ord"), F.col("pin").cast("long").alias("pin_ord"))
    nets = net_pins.groupBy("design_id", "net").agg(F.min("net_ord").alias("net_ord"))
    return Netlist(components, component_pins, net_pins, nets)


def settled(spark: SparkSession, sf_dir: str) -> Netlist:
    """The netlist with its pins computed once; a traversal reads them many times."""
    net = netlist(spark, sf_dir)
    pins = xnet.cut(net.net_pins)
    nets = xnet.cut(pins.groupBy("design_id", "net").agg(F.min("net_ord").alias("net_ord")))
    own = pins.select("design_id", "refdes", "pin", F.lit(None).cast("string").alias("pin_name"), "net", "pin_ord")
    return replace(net, component_pins=own, net_pins=pins, nets=nets)


def ranked_pins(spark: SparkSession, sf_dir: str, part: DataFrame) -> DataFrame:
    """(design_id, refdes, pin, net, l_orderkey, l_partkey)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    tie = ["l_orderkey", "l_linenumber", "l_suppkey"]
    # One order serves both ends: the dearest line with the least keys is the first one of the last price.
    by_price = Window.partitionBy("l_partkey").orderBy("l_extendedprice", *tie)
    price, low = F.col("l_extendedprice"), F.row_number().over(by_price)
    last = F.last("l_extendedprice").over(by_price.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = lines.withColumns({"low": low, "last": last, "before": F.lag("l_extendedprice").over(by_price)})
    dearest = price.eqNullSafe(F.col("last")) & ((F.col("low") == 1) | ~price.eqNullSafe(F.col("before")))
    kept = ranked.withColumn("high", F.when(dearest, 1).otherwise(0)).where((F.col("low") <= ACTIVE_PINS) | (F.col("high") == 1))
    joined = kept.join(part.select("p_partkey", "p_type"), kept.l_partkey == F.col("p_partkey"))
    passive = F.col("p_type").isin(list(PREFIXES)[:4])
    pin = F.when(passive, F.filter(F.array(F.when(F.col("low") == 1, F.lit("1")), F.when(F.col("high") == 1, F.lit("2"))), lambda x: x.isNotNull()))
    pin = pin.otherwise(F.when(F.col("low") <= ACTIVE_PINS, F.array(F.col("low").cast("string"))).otherwise(F.array().cast("array<string>")))
    return joined.select(F.lit(DESIGN).alias("design_id"), refdes_of(F.col("p_type"), F.col("p_partkey")).alias("refdes"), F.explode(pin).alias("pin"), net_of(F.col("l_orderkey")).alias("net"), "l_orderkey", "l_partkey")


def every_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(refdes, pin, net) with each line of a part as a pin, numbered by price: parts of any number of pins."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    placed = numbered(lines, ["l_partkey"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"], "place", xnet.cut)
    joined = placed.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(refdes_of(F.col("p_type"), F.col("p_partkey")).alias("refdes"), (F.col("place") + 1).cast("string").alias("pin"), net_of(F.col("l_orderkey")).alias("net"))


def cadence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projection as the lines of text exports, a design per brand, in blocks of bounded size (see ``sources.splits``)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("refdes", refdes_of(F.col("p_type"), F.col("p_partkey")))
    pins = xnet.cut(ranked_pins(spark, sf_dir, part).join(part.select("p_brand", "refdes"), "refdes").select("p_brand", "refdes", "pin", "net"))
    text = lambda *pieces: F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p) for p in pieces])
    sections = lambda kind, name, lines: (F.lit(kind).alias("kind"), F.col(name).alias("section"), F.posexplode(F.array(*lines)).alias("n", "line"))
    net = pins.select("p_brand", "net").distinct().select("p_brand", *sections("pstxnet", "net", [F.lit("NET_NAME"), text("='", "net", "='")]))
    node = pins.select("p_brand", F.lit("pstxnet").alias("kind"), F.col("net").alias("section"), F.lit(2).alias("n"), text("=NODE_NAME ", "refdes", "= ", "pin").alias("line"))
    number = F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("MFGR_PN='"), "p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("';")))
    component = part.select("p_brand", *sections("pstxprt", "refdes", [F.lit("PART_NAME"), text("refdes", "= '", "p_type", "=':;"), number, text('=DESCR="', "p_name", '=",')])).where("line IS NOT NULL")
    body = F.concat(F.lit("VALUE='"), F.lower("p_type"), F.lit("';"))
    fixed = lambda *lines: [F.lit(x) for x in lines]
    kinds = part.select("p_brand", "p_type").distinct()
    chip = kinds.select("p_brand", *sections("pstchip", "p_type", [text("=primitive '", "p_type", "=';"), *fixed("pin", "'FIRST':", "PIN_NUMBER='(1)';", "end_pin;", "body"), body, *fixed("end_body;")]))
    rows = net.unionByName(node).unionByName(component).unionByName(chip).withColumnRenamed("p_brand", "design_id")
    placed = numbered(xnet.cut(rows), ["design_id", "kind"], ["section", "n", "line"], "at", xnet.cut)
    return placed.select("design_id", "kind", F.expr(f"at div {BLOCK_LINES}").alias("block"), "at", "line")
