"""Grouping of components and of traversal rows, as set operations over any number of designs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from copperline.functions import exprs
from copperline.plans.netlist import with_dns


def group_by_mpn(components: DataFrame, include_dns: bool = False) -> DataFrame:
    """Components that share a part number and do-not-stuff mark, one row each; parts without a number stay alone.

    The first component supplies description and comment; value is the first that is not blank. Columns:
    design_id, mpn, description, comment, value, dns, refdes (array, natural order), count, notes, first_ord.
    """
    rows = with_dns(components)
    if not include_dns:
        rows = rows.where(~F.col("dns"))
    mpn = exprs.filled(F.col("mpn"))
    rows = rows.withColumns({"mpn": mpn, "alone": F.when(mpn.isNull(), F.col("refdes")), "filled_value": exprs.filled(F.col("value"))})
    first = lambda c: F.min_by(exprs.filled(F.col(c)), "comp_ord")
    value_ord = F.when(F.col("filled_value").isNotNull(), F.col("comp_ord"))
    out = rows.groupBy("design_id", "mpn", "alone", "dns").agg(
        first("description").alias("description"),
        first("comment").alias("comment"),
        F.min_by("filled_value", value_ord).alias("value"),
        exprs.naturally_sorted(F.collect_list("refdes")).alias("refdes"),
        F.count("*").alias("count"),
        F.min("comp_ord").alias("first_ord"),
    )
    notes = F.when(F.col("mpn").isNull(), F.array(F.lit(exprs.MPN_MISSING_NOTE)))
    return out.select("design_id", "mpn", "description", "comment", "value", F.when(F.col("dns"), True).alias("dns"), "refdes", "count", notes.alias("notes"), "first_ord")


def group_order() -> list[Column]:
    """Sort keys of ``group_by_mpn`` rows."""
    return [F.col("design_id"), exprs.collated(F.coalesce("mpn", F.lit(""))), F.col("first_ord")]


def circuit_components(pins: DataFrame, key: list[str]) -> DataFrame:
    """One row per component of a circuit: its pins by net, connections in the natural order of their first pin.

    ``pins`` has key, refdes, pin, net, mpn, mpn_present, description, comment, value, dns.
    """
    by_net = pins.groupBy(*key, "refdes", "net").agg(
        exprs.naturally_sorted(F.collect_set("pin")).alias("pins"),
        *[F.first(c).alias(c) for c in ("mpn", "mpn_present", "description", "comment", "value", "dns")],
    )
    entry = F.struct(exprs.natural_key(F.get("pins", F.lit(0))).alias("k"), F.col("net").alias("net"), F.col("pins").alias("pins"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(s["net"].alias("net"), s["pins"].alias("pins")))
    return by_net.groupBy(*key, "refdes").agg(ordered.alias("connections"), *[F.first(c).alias(c) for c in ("mpn", "mpn_present", "description", "comment", "value", "dns")])


def aggregate_circuits(components: DataFrame, key: list[str]) -> DataFrame:
    """Components of a circuit with one part number (else description), the same nets and do-not-stuff mark, one row.

    Within a group, components whose pins meet the nets alike share an orientation; orientations are ordered by
    count, ties by the natural order of their first refdes. Components without number and description stay
    alone. Columns: key, mpn, description, comment, value, dns, notes, total_count,
    orientations (count, refdes, connections).
    """
    mpn, description = exprs.filled(F.col("mpn")), exprs.filled(F.col("description"))
    name = F.coalesce(F.concat(F.lit("mpn:"), mpn), F.concat(F.lit("desc:"), description), F.concat(F.lit("refdes:"), F.col("refdes")))
    nets = F.array_join(F.array_sort(F.transform("connections", lambda c: c["net"])), "|")
    way = F.array_join(F.transform("connections", lambda c: F.concat(F.array_join(c["pins"], ","), F.lit(":"), c["net"])), "|")
    alone = mpn.isNull() & description.isNull()
    rows = components.withColumns({"group": name, "nets": nets, "way": way, "order": F.struct(exprs.natural_key(F.col("refdes")), "refdes"), "alone": alone})
    rows = rows.withColumns({"mpn": mpn, "description": F.when(alone, F.col("description")).otherwise(description), "value": F.when(alone, F.col("value")).otherwise(exprs.filled(F.col("value")))})
    ways = rows.groupBy(*key, "group", "nets", "dns", "way").agg(
        F.count("*").alias("count"),
        exprs.naturally_sorted(F.collect_list("refdes")).alias("refdes"),
        F.min("order").alias("first"),
        F.first("connections").alias("connections"),
        F.first("mpn").alias("mpn"),
        F.min_by("description", "order").alias("description"),
        F.min_by("comment", "order").alias("comment"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("order", "value"))).alias("valued"),
    )
    orientation = F.struct((-F.col("count")).alias("c"), F.col("first").alias("f"), F.struct("count", "refdes", "connections").alias("o"))
    out = ways.groupBy(*key, "group", "nets", "dns").agg(
        F.first("mpn").alias("mpn"),
        F.min_by("description", "first").alias("description"),
        F.min_by("comment", "first").alias("comment"),
        F.min("valued").getField("value").alias("value"),
        F.sum("count").alias("total_count"),
        F.transform(F.array_sort(F.collect_list(orientation)), lambda s: s["o"]).alias("orientations"),
        F.min("first").alias("first"),
    )
    notes = F.when(F.col("mpn").isNull(), F.array(F.lit(exprs.MPN_MISSING_NOTE)))
    last = F.startswith("group", F.lit("refdes:"))
    return out.select(*key, "mpn", "description", "comment", "value", "dns", notes.alias("notes"), "total_count", "orientations", F.struct(last.alias("alone"), "first").alias("rank"), F.col("nets").alias("net_signature"))


def circuit_hash(components: DataFrame, key: list[str]) -> DataFrame:
    """(key, circuit_hash): 16 hex digits over refdes, part number and wiring of all components of a circuit.

    The text that is hashed is compact JSON, which a task hands to the digest part by part; a part number that the source does not know is left out, one that it
    knows to be missing is null.
    """
    wiring = F.transform(F.array_sort(F.transform("connections", lambda c: F.struct(c["net"].alias("k"), exprs.naturally_sorted(c["pins"]).alias("pins"), c["net"].alias("net")))), lambda s: F.struct(s["pins"].alias("pins"), s["net"].alias("net")))
    keep = {"ignoreNullFields": "false"}
    known = F.to_json(F.struct("refdes", "mpn", wiring.alias("connections")), keep)
    unknown = F.to_json(F.struct("refdes", wiring.alias("connections")), keep)
    part = F.when(F.coalesce("mpn_present", F.lit(False)), known).otherwise(unknown)
    order = [*key, "k", "refdes", "body"]
    rows = components.select(*key, exprs.natural_key(F.col("refdes")).alias("k"), "refdes", part.alias("body"))
    return digests(rows.repartition(*key).sortWithinPartitions(*order).select(*key, "body"), key)


def digests(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, circuit_hash) of rows (key, body) that stand key by key in their order: a task holds one batch of bodies, whatever a key's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, state = None, None
        for batch in batches:
            done = []
            for *own, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own == owner:
                    state.update(b",")
                else:
                    if state:
                        done.append([*owner, _ended(state)])
                    owner, state = own, hashlib.sha256(b"[")
                state.update(body.encode())
            if done:
                yield told(done)
        if state:
            yield told([[*owner, _ended(state)]])

    def told(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names=[*key, "circuit_hash"])

    types = [to_arrow_type(rows.schema[k].dataType) for k in key] + [pa.string()]
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    return rows.select(*key, "body").mapInArrow(run, f"{fields}, circuit_hash string")


def _ended(state) -> str:
    state.update(b"]")
    return state.hexdigest()[:16]


EMPTY_HASH = "0" * 16
