"""The relational netlist: four tables keyed by design, the contract between sources and operators.

components      design_id, refdes, mpn, mpn_present, description, comment, value, comp_ord
component_pins  design_id, refdes, pin, pin_name, net, pin_ord
net_pins        design_id, net, refdes, pin, net_ord, ref_ord, pin_ord
nets            design_id, net, net_ord

Both pin tables are kept: a net may name parts that no component row describes, and a component may have pins
that no net holds. Orders are the insertion orders of the source, in which integer-like keys come first.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from copperline.functions import exprs

COMPONENTS = "design_id string, refdes string, mpn string, mpn_present boolean, description string, comment string, value string, comp_ord long"
COMPONENT_PINS = "design_id string, refdes string, pin string, pin_name string, net string, pin_ord long"
NET_PINS = "design_id string, net string, refdes string, pin string, net_ord long, ref_ord long, pin_ord long"
NETS = "design_id string, net string, net_ord long"


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


@dataclass(frozen=True)
class Netlist:
    components: DataFrame
    component_pins: DataFrame
    net_pins: DataFrame
    nets: DataFrame

    def design(self, design_id: str) -> Netlist:
        """One design; a filter that reaches the scan."""
        mine = F.col("design_id") == design_id
        return Netlist(*(t.where(mine) for t in (self.components, self.component_pins, self.net_pins, self.nets)))

    def normalised(self) -> Netlist:
        """Unconnected component pins name the net NC; the nets table is not touched."""
        return replace(self, component_pins=self.component_pins.withColumn("net", exprs.connected(F.col("net"))))

    def checked(self) -> Netlist:
        """Only the contract's columns, in its types."""
        tables = []
        for df, ddl in ((self.components, COMPONENTS), (self.component_pins, COMPONENT_PINS), (self.net_pins, NET_PINS), (self.nets, NETS)):
            tables.append(df.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in ddl.split(", ")]))
        return Netlist(*tables)

    def column_faults(self) -> list[str]:
        """Columns of the contract that a table lacks or has in another type."""
        out = []
        for name, df, ddl in (("components", self.components, COMPONENTS), ("component_pins", self.component_pins, COMPONENT_PINS), ("net_pins", self.net_pins, NET_PINS), ("nets", self.nets, NETS)):
            own = {f.name: f.dataType for f in df.schema}
            for field in StructType.fromDDL(ddl):
                if field.name not in own:
                    out.append(f"{name}.{field.name} is missing")
                elif own[field.name] != field.dataType:
                    out.append(f"{name}.{field.name} is {own[field.name].simpleString()} and not {field.dataType.simpleString()}")
        return out

    def validated(self) -> Netlist | None:
        """The contract's columns of a netlist that keeps the whole contract, else None."""
        return None if self.column_faults() or not self.problems().isEmpty() else self.checked()

    def problems(self) -> DataFrame:
        """(of_table, design_id, name, problem) of rows that break the contract: missing or repeated keys, pins without a net row."""
        found = []
        for table, df, key in (("components", self.components, ["refdes"]), ("component_pins", self.component_pins, ["refdes", "pin"]), ("net_pins", self.net_pins, ["net", "refdes", "pin"]), ("nets", self.nets, ["net"])):
            name = F.concat_ws(".", *key).alias("name")
            missing = " OR ".join(f"{c} IS NULL" for c in ["design_id", *key])
            found.append(df.where(missing).select(F.lit(table).alias("of_table"), "design_id", name, F.lit("key is missing").alias("problem")))
            if table != "net_pins":  # a net may list a pin twice
                found.append(df.where(f"NOT ({missing})").groupBy("design_id", *key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(table), "design_id", name, F.lit("key is repeated")))
        known = self.net_pins.where("design_id IS NOT NULL AND net IS NOT NULL")
        found.append(known.join(self.nets, ["design_id", "net"], "left_anti").select(F.lit("net_pins"), "design_id", F.col("net"), F.lit("no such net")).distinct())
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def write(self, path: str) -> None:
        """Parquet, partitioned by design and sorted by the key that each table is looked up by."""
        for name, df, key in (("components", self.components, "refdes"), ("component_pins", self.component_pins, "refdes"), ("net_pins", self.net_pins, "net"), ("nets", self.nets, "net")):
            df.repartitionByRange("design_id", key).sortWithinPartitions("design_id", key).write.mode("errorifexists").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Netlist:
        return Netlist(*(spark.read.parquet(f"{path}/{name}") for name in ("components", "component_pins", "net_pins", "nets")))


def with_dns(components: DataFrame) -> DataFrame:
    return components.withColumn("dns", exprs.is_dns(F.col("mpn"), F.col("description"), F.col("comment")))


def from_rows(spark: SparkSession, designs: dict[str, dict]) -> Netlist:
    """Tables of small literal netlists: {design: {"components": {refdes: {..., "pins": {pin: net or (name, net)}}}, "nets": {net: {refdes: [pins]}}}}.

    Without "nets" these are derived from the components' pins.
    """
    comps, pins, net_pins, nets = [], [], [], []
    for design, content in designs.items():
        by_net: dict[str, dict[str, list[str]]] = {}
        for c, (refdes, part) in enumerate(content["components"].items()):
            comps.append((design, refdes, part.get("mpn"), "mpn" in part, part.get("description"), part.get("comment"), part.get("value"), c))
            for p, (pin, entry) in enumerate((part.get("pins") or {}).items()):
                name, net = entry if isinstance(entry, tuple) else (None, entry)
                pins.append((design, refdes, pin, name, net, p))
                if net not in ("", exprs.NOT_CONNECTED):
                    by_net.setdefault(net, {}).setdefault(refdes, []).append(pin)
        for n, (net, refs) in enumerate(content.get("nets", by_net).items()):
            nets.append((design, net, n))
            for r, (refdes, own) in enumerate(refs.items()):
                net_pins += [(design, net, refdes, pin, n, r, p) for p, pin in enumerate(own)]
    return Netlist(spark.createDataFrame(comps, COMPONENTS), spark.createDataFrame(pins, COMPONENT_PINS), spark.createDataFrame(net_pins, NET_PINS), spark.createDataFrame(nets, NETS))
