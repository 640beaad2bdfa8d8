"""Answers for extended nets as rows, for any number of asked nets in one plan.

Rows are (design_id, root, kind, place, body). Kinds: totals (one row), group (components rolled up, the largest first), visited
(nets, by distance and name) and skipped (parts that each type left out). The body is JSON, made where the rows are;
a reader of one answer takes its rows in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperline.operators import grouping, xnet
from copperline.plans.netlist import Netlist

KEY = ["design_id", "root"]


def _text(c: Column) -> Column:
    """A string as JSON, null for none."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def _compact(values: Column) -> Column:
    """An array of strings as JSON; one string stands for itself."""
    return F.when(F.size(values) == 1, _text(values[0])).otherwise(F.to_json(values))


def _connections(c: Column) -> Column:
    each = F.transform(c, lambda x: F.concat(F.lit('{"net":'), _text(x["net"]), F.lit(',"pins":'), _compact(x["pins"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def group_body() -> Column:
    """A row of ``aggregate_circuits`` as JSON; what is not known is left out, a missing part number is null."""
    known = lambda name, value: F.when(F.col(name).isNotNull(), F.concat(F.lit(f',"{name}":'), value)).otherwise("")
    head = [F.lit('{"mpn":'), _text(F.col("mpn")), F.lit(',"total_count":'), F.col("total_count").cast("string")]
    head += [known(n, _text(F.col(n))) for n in ("description", "comment", "value")]
    head += [known("dns", F.col("dns").cast("string")), known("notes", F.to_json("notes"))]
    way = lambda o: F.concat(F.lit('"refdes":'), _compact(o["refdes"]), F.lit(',"connections":'), _connections(o["connections"]))
    counted = F.transform("orientations", lambda o: F.concat(F.lit('{"count":'), o["count"].cast("string"), F.lit(","), way(o), F.lit("}")))
    one = F.concat(F.lit(","), way(F.col("orientations")[0]))
    many = F.concat(F.lit(',"orientations":['), F.array_join(counted, ","), F.lit("]"))
    return F.concat(*head, F.when(F.size("orientations") == 1, one).otherwise(many), F.lit("}"))


def _placed(rows: DataFrame, kind: str, order: list[Column], body: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)) - 1
    return rows.select(*KEY, F.lit(kind).alias("kind"), place.cast("long").alias("place"), body.alias("body"))


def circuits(netlist: Netlist, starts: DataFrame, skip_types: list[str] = (), include_dns: bool = False) -> DataFrame:
    """The answers for each start (design_id, root); starts that are no net have none."""
    seen = xnet.cut(xnet.reach(netlist, starts, skip_types, include_dns))
    made = xnet.cut(grouping.circuit_components(xnet.circuit_pins(netlist, seen, skip_types, include_dns), KEY))
    groups = xnet.cut(grouping.aggregate_circuits(made, KEY))
    n = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    totals = seen.select(*KEY).distinct().join(n(made, "total_components"), KEY, "left").join(n(groups, "unique_configurations"), KEY, "left").join(grouping.circuit_hash(made, KEY), KEY, "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total_components", "unique_configurations")]
    whole = F.to_json(F.struct(*zero, F.coalesce("circuit_hash", F.lit(grouping.EMPTY_HASH)).alias("circuit_hash")))
    out = totals.select(*KEY, F.lit("totals").alias("kind"), F.lit(0).cast("long").alias("place"), whole.alias("body"))
    out = out.unionByName(_placed(groups, "group", [F.desc("total_count"), F.col("rank"), F.col("net_signature")], group_body()))
    out = out.unionByName(_placed(seen, "visited", [F.col("hop"), F.col("net")], _text(F.col("net"))))
    if skip_types:
        skipped = xnet.skipped_counts(netlist, seen, list(skip_types), include_dns)
        out = out.unionByName(_placed(skipped, "skipped", [F.col("skip_type")], F.to_json(F.struct("skip_type", "n"))))
    return out
