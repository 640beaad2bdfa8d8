"""Comparing two netlists: what one has that the other lacks or has otherwise.

Rows are compared from above. Each table of a design has a number of rows and an order-free sum of their hashes, and so has
each part or net in it. Designs, then parts and nets, whose numbers and sums agree are left out, so that only what
differs is joined row by row. A net's list of pins may hold a pin more than once; every further one counts for itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperline.plans.netlist import Netlist

#: Of each table: the part or net that a row belongs to, and what names the row. Orders count as contents only where asked.
KEYS = {"components": ("refdes", ["refdes"]), "component_pins": ("refdes", ["refdes", "pin"]), "net_pins": ("net", ["net", "refdes", "pin"]), "nets": ("net", ["net"])}


def flat_rows(netlist: Netlist, orders: bool = False) -> DataFrame:
    """(of_table, design_id, part_or_net, name, content) of every row; content is JSON of its fields, of ``orders`` too if asked."""
    out = []
    for table, (group, key) in KEYS.items():
        rows = getattr(netlist, table)
        fields = [c for c in rows.columns if c not in ("design_id", *key) and (orders or not c.endswith("_ord"))]
        content = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
        name = F.concat_ws(".", *key)
        if table == "net_pins":
            again = F.row_number().over(Window.partitionBy("design_id", *key).orderBy(content))
            rows = rows.withColumn("again", again)
            name = F.when(F.col("again") > 1, F.concat(name, F.lit("#"), F.col("again").cast("string"))).otherwise(name)
        out.append(rows.select(F.lit(table).alias("of_table"), "design_id", F.col(group).alias("part_or_net"), name.alias("name"), content.alias("content")))
    return reduce(DataFrame.unionByName, out)


def _unlike(was: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """The keys whose numbers of rows or sums of hashes differ."""
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("name", "content").cast("decimal(38, 0)")).alias("sum")]
    old, new = (df.groupBy(*key).agg(*digest) for df in (was, now))
    both = old.withColumnsRenamed({"n": "n0", "sum": "sum0"}).join(new, key, "full_outer")
    return both.where(~(F.col("n0").eqNullSafe(F.col("n")) & F.col("sum0").eqNullSafe(F.col("sum")))).select(*key)


def differences(was: Netlist, now: Netlist, orders: bool = False) -> DataFrame:
    """(of_table, design_id, part_or_net, name, change, was, now): rows that were added, lost or changed, with their contents as JSON."""
    old, new = flat_rows(was, orders), flat_rows(now, orders)
    for key in (["of_table", "design_id"], ["of_table", "design_id", "part_or_net"]):
        unlike = _unlike(old, new, key)
        old, new = old.join(unlike, key, "left_semi"), new.join(unlike, key, "left_semi")
    key = ["of_table", "design_id", "part_or_net", "name"]
    rows = old.withColumnRenamed("content", "was").join(new.withColumnRenamed("content", "now"), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "lost").otherwise("changed")
    return rows.where(~F.col("was").eqNullSafe(F.col("now"))).select(*key[:-1], "name", change.alias("change"), "was", "now")
