"""Text exports read in splits: a file of any size is the work of many tasks.

A split is a range of a file's bytes; a line belongs to the split that its first byte is in. Lines are rows (design_id,
kind, block, at, line), trimmed, where ``at`` is the first byte's place and ``block`` the split's number. What a line means
depends on lines before it (the net, part or primitive that it stands under), which may lie in other splits. These
states are the last header, mark or name met, so what a split does to them is one row, and the splits' rows are
carried on in their order before lines meet them (``ordering.carried``). The rows made are those of the sequential
readers in ``cadence``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators.ordering import by_width, carried, numbered
from copperline.operators.xnet import cut
from copperline.sources.files import opened

#: Bytes of a split, of a read, and lines of a batch.
SPLIT, READ, BATCH = 64 << 20, 1 << 20, 16_384
LINES = "design_id string, kind string, block long, at long, line string"
DESIGN = ["design_id"]


def split_lines(source, size: int, start: int, length: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, start + length) of a seekable source of ``size`` bytes, without their ends.

    Nothing begins after the last byte.
    """
    end, at, held = min(start + length, size), max(start - 1, 0), b""
    before = start > 0  # within a line that began before, or at its end
    source.seek(at)
    while at < end:
        stop = held.find(b"\n")
        while stop < 0 and (more := source.read(READ)):
            if before:
                at, held = at + len(held), b""
            seen, held = len(held), held + more
            stop = held.find(b"\n", seen)
        if before:
            if stop < 0:
                return
            at, held, before = at + stop + 1, held[stop + 1 :], False
        elif stop < 0:
            yield at, held
            return
        else:
            *lines, held = held.split(b"\n")
            for line in lines:
                if at >= end:
                    return
                yield at, line
                at += len(line) + 1


def ranges(wanted: DataFrame, split: int = SPLIT) -> DataFrame:
    """The rows (path, ...) with the file's size and the start of each of its splits. Missing and empty files give none."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    with opened(path) as f:
                        found.append((path, f.size()))
                except (FileNotFoundError, IsADirectoryError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "size"])

    sized = cut(wanted.select("path").distinct().mapInArrow(sizes, "path string, size long"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))
    return wanted.join(sized.where("size > 0"), "path").select("*", F.explode(starts).alias("start"))


def read_lines(wanted: DataFrame, split: int = SPLIT) -> DataFrame:
    """The lines of the files that rows (design_id, kind, path) name, in splits of so many bytes. Missing files give none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for design, kind, path, size, start in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                with opened(path) as f:
                    for lines in line_batches(f, size, start, split):
                        yield batch(design, kind, start // split, *lines)

    rows = ranges(wanted.select("design_id", "kind", "path"), split).select("design_id", "kind", "path", "size", "start")
    n = rows.count()
    # A split is a task; without a number, adaptive execution would join these few rows into one partition.
    return rows.repartition(max(1, min(n, 1 << 15)), "path", "start").mapInArrow(read, LINES).withColumn("line", exprs.trimmed(F.col("line")))


def line_batches(source, size: int, start: int, length: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The lines of ``split_lines`` as arrays (places, lines), at most BATCH at a time: the lines that a read ends are split at once."""
    end, at, held = min(start + length, size), max(start - 1, 0), b""
    before = start > 0
    source.seek(at)
    while at < end:
        more = source.read(READ)
        stop, last = more.rfind(b"\n"), not more
        if before:
            begun = more.find(b"\n")
            if last:
                return
            if begun < 0:
                at += len(more)
                continue
            at, more, stop, before = at + begun + 1, more[begun + 1 :], stop - begun - 1, False
        if stop < 0 and not last:
            held += more
            continue
        lines = pc.list_flatten(pc.split_pattern(pa.array([held if last else held + more[:stop]], pa.large_binary()), b"\n"))
        held = more[stop + 1 :]
        sizes = pc.add(pc.binary_length(lines).cast(pa.int64()), 1)
        ends = pc.cumulative_sum(sizes)
        places = pc.add(pc.subtract(ends, sizes), at)
        n = pc.sum(pc.less(places, end)).as_py()
        for k in range(0, n, BATCH):
            yield places[k : min(k + BATCH, n)], lines[k : min(k + BATCH, n)]
        if last:
            return
        at += ends[-1].as_py()


def batch(design: str, kind: str, block: int, places: pa.Array, lines: pa.Array) -> pa.RecordBatch:
    """Lines (place, bytes) of a split as rows of LINES."""
    same = lambda value, t: pa.repeat(pa.scalar(value, t), len(lines))
    try:
        text = lines.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        text = pa.array([x.decode("utf-8", "replace") for x in lines.to_pylist()], pa.string())
    columns = [same(design, pa.string()), same(kind, pa.string()), same(block, pa.int64()), places, text]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in LINES.split(", ")])


def _under(lines: DataFrame, kind: str, header: Column) -> DataFrame:
    """Lines of a kind with ``head``, the place of the header that they stand under; -1 before any. Headers themselves go."""
    rows = carried(lines.where(F.col("kind") == kind), DESIGN, "block", "at", {"head": F.when(header, F.col("at"))})
    return rows.withColumn("head", F.coalesce("head", F.lit(-1)))


def _ranked(rows: DataFrame, key: list[str], column: str, first: str, name: str) -> DataFrame:
    """(key, column, name): places of the distinct names as objects of the source tools list them, ``first`` being where each was met."""
    order = exprs.map_order(F.col(column), F.col(first))
    placed = rows.withColumns({"k_kind": order["c"], "k_place": order["o"]})
    return numbered(placed, key, ["k_kind", "k_place"], name, cut).drop("k_kind", "k_place", first)


def _held_pins(nodes: DataFrame, key: list[str]) -> DataFrame:
    """The nodes with ``ref_ord`` and ``pin_ord``, a net being held by one task."""
    ref = Window.partitionBy(*key, "refdes")
    rows = nodes.repartition(*key).withColumns({"pin_ord": (F.row_number().over(ref.orderBy("at")) - 1).cast("long"), "first": F.min("at").over(ref)})
    order = exprs.map_order(F.col("refdes"), F.col("first"))
    rows = rows.withColumns({"k_kind": order["c"], "k_place": order["o"]})
    place = F.dense_rank().over(Window.partitionBy(*key).orderBy("k_kind", "k_place")) - 1
    return rows.withColumn("ref_ord", place.cast("long")).drop("k_kind", "k_place", "first")


def nets(lines: DataFrame) -> DataFrame:
    """(design_id, net, net_ord, refdes, ref_ord, pin, pin_ord); a net without nodes has one row of nulls. A repeated net replaces the earlier one."""
    line = F.col("line")
    rows = _under(lines, "pstxnet", line == "NET_NAME")
    quoted = F.startswith(line, F.lit("'")) & F.endswith(line, F.lit("'"))
    words = F.when(F.startswith(line, F.lit("NODE_NAME")), F.split(line, exprs.SPACE + "+"))
    told = rows.select(*DESIGN, "head", "at", F.when(quoted, F.expr("substring(line, 2, length(line) - 2)")).alias("name"), words.alias("words"))
    told = cut(told.where("name IS NOT NULL OR size(words) >= 3").select(*DESIGN, "head", "at", "name", F.col("words")[1].alias("refdes"), F.col("words")[2].alias("pin")))
    named = told.where("name IS NOT NULL").groupBy(*DESIGN, "head").agg(F.min_by("name", "at").alias("net"))
    named = cut(named.groupBy(*DESIGN, "net").agg(F.max("head").alias("head"), F.min("head").alias("first")))
    order = _ranked(named.select(*DESIGN, "net", "first"), DESIGN, "net", "first", "net_ord")
    held = cut(named.drop("first").join(order, [*DESIGN, "net"]))
    nodes = told.where("refdes IS NOT NULL").select(*DESIGN, "head", "at", "refdes", "pin")
    nodes = cut(nodes.join(held, [*DESIGN, "head"]).select(*DESIGN, "net", "net_ord", "refdes", "pin", "at"))
    key = [*DESIGN, "net"]
    narrow, wide = by_width(nodes, key, cut)
    pins = _held_pins(narrow, key)
    if wide is not None:
        refs = _ranked(cut(wide.groupBy(*key, "refdes").agg(F.min("at").alias("first"))), key, "refdes", "first", "ref_ord")
        pins = pins.unionByName(numbered(wide, [*key, "refdes"], ["at"], "pin_ord", cut).join(refs, [*key, "refdes"]))
    columns = ["design_id", "net", "net_ord", "refdes", "ref_ord", "pin", "pin_ord"]
    empty = held.join(nodes.select(*key).distinct(), key, "left_anti").select(*key, "net_ord", F.lit(None).cast("string").alias("refdes"), F.lit(None).cast("long").alias("ref_ord"), F.lit(None).cast("string").alias("pin"), F.lit(None).cast("long").alias("pin_ord"))
    return pins.select(*columns).unionByName(empty.select(*columns))


def _property(quotes: str) -> tuple[Column, Column, Column]:
    """(has one, key, value) of a line key=value, its quotes taken off."""
    line, at = F.col("line"), F.instr("line", "=")
    value = exprs.trimmed(F.substring("line", at + 1, F.length("line")))
    value = F.when(F.substring(value, 1, 1).isin("'", '"'), F.substring(value, F.lit(2), F.length(value))).otherwise(value)
    return at > 0, exprs.trimmed(F.substring(line, F.lit(1), at - 1)), F.regexp_replace(value, f"[{quotes}]+\\z", "")


def parts(lines: DataFrame) -> DataFrame:
    """(design_id, refdes, comp_ord, part_name, mpn, description); a repeated refdes replaces the earlier one."""
    line = F.col("line")
    rows = _under(lines, "pstxprt", line == "PART_NAME").where(line != "PART_NAME")
    opens = F.contains(line, F.lit(" ")) & (F.endswith(line, F.lit(":")) | F.endswith(line, F.lit(":;")))
    heads = rows.where(opens).groupBy(*DESIGN, "head").agg(F.min(F.struct("at", "line")).alias("o"))
    whole = rf"^((?:(?!{exprs.SPACE}).)+){exprs.SPACE}+'([^']+)'"
    told = F.nullif(F.regexp_extract("o.line", whole, 1), F.lit(""))
    heads = heads.select(*DESIGN, "head", F.col("o.at").alias("opened"), F.coalesce(told, F.split("o.line", " ")[0]).alias("refdes"), F.when(told.isNotNull(), F.regexp_extract("o.line", whole, 2)).alias("part_name"))
    heads = cut(heads)
    some, key, value = _property("'\";,")
    said = rows.where(some & key.isin("MFGR_PN", "DESCR")).select(*DESIGN, "head", "at", key.alias("k"), value.alias("v"))
    said = said.join(heads.select(*DESIGN, "head", "opened"), [*DESIGN, "head"]).where("at > opened")
    last = lambda k: F.nullif(F.max_by("v", F.when(F.col("k") == k, F.col("at"))), F.lit(""))
    said = said.groupBy(*DESIGN, "head").agg(last("MFGR_PN").alias("number"), last("DESCR").alias("descr"))
    rows = heads.join(said, [*DESIGN, "head"], "left").withColumn("mpn", F.coalesce("number", "part_name"))
    latest = rows.groupBy(*DESIGN, "refdes").agg(
        F.min("head").alias("first"),
        F.max_by("part_name", F.when(F.col("part_name").isNotNull(), F.col("head"))).alias("part_name"),
        F.max_by(F.struct("mpn", F.col("descr").alias("description")), "head").alias("own"),
    )
    latest = cut(latest)
    order = _ranked(latest.select(*DESIGN, "refdes", "first"), DESIGN, "refdes", "first", "comp_ord")
    return latest.join(order, [*DESIGN, "refdes"]).select(*DESIGN, "refdes", "comp_ord", "part_name", "own.mpn", "own.description")


def chips(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, names): of each part the VALUE of its last primitive that has one, and the pin names of its last primitive.

    Values are (design_id, part_name, chip_value), names (design_id, part_name, pin, pin_name). Blocks open at the lines pin
    and body; end_pin; closes a pin block only.
    """
    line, at = F.col("line"), F.col("at")
    rows = lines.where(F.col("kind") == "pstchip")
    head = F.startswith(line, F.lit("primitive "))
    states = {"head": F.when(head, F.struct("at", F.regexp_extract("line", rf"primitive{exprs.SPACE}+'([^']+)'", 1).alias("part"))), "mark": F.when(line.isin("pin", "body"), F.struct("at", "line")), "closed": F.when(line == "end_pin;", at)}
    rows = carried(rows, DESIGN, "block", "at", states).where(~head & (F.col("head.part") != "") & (F.col("mark.at") > F.col("head.at")) & ~line.isin("pin", "body", "end_pin;"))
    rows = rows.select(*DESIGN, "block", "at", "line", F.col("head.at").alias("head"), F.col("head.part").alias("part_name"), F.col("mark.at").alias("opened"), F.col("mark.line").alias("inside"), "closed")
    some, key, value = _property("'\";")
    bodies = rows.where((F.col("inside") == "body") & some & (key == "VALUE")).groupBy(*DESIGN, "part_name", "head").agg(F.max_by(value, "at").alias("chip_value"))
    values = bodies.where("chip_value <> ''").groupBy(*DESIGN, "part_name").agg(F.max_by("chip_value", "head").alias("chip_value"))

    pins = rows.where((F.col("inside") == "pin") & (F.col("closed").isNull() | (F.col("closed") < F.col("opened"))))
    names = F.startswith(line, F.lit("'")) & F.contains(line, F.lit(":"))
    found = F.nullif(F.regexp_extract("line", "'([^']+)':", 1), F.lit(""))
    pins = carried(pins, DESIGN, "block", "at", {"name": F.when(names & found.isNotNull(), F.struct("at", found.alias("name")))})
    numbers = pins.where(~names & (F.col("name.at") > F.col("opened")) & F.contains(line, F.lit("PIN_NUMBER")) & F.contains(line, F.lit("=")))
    number = F.regexp_replace(exprs.trimmed(F.split("line", "=")[1]), r"""^['";()]+|['";()]+\z""", "")
    numbers = numbers.select(*DESIGN, "part_name", "head", F.col("name.name").alias("pin_name"), "at", number.alias("pin"))
    by_name = numbers.groupBy(*DESIGN, "part_name", "head", "pin_name").agg(F.max_by("pin", "at").alias("pin"), F.min("at").alias("place"))
    last = lines.where((F.col("kind") == "pstchip") & head).select(*DESIGN, F.col("at").alias("head"), F.regexp_extract("line", rf"primitive{exprs.SPACE}+'([^']+)'", 1).alias("part_name"))
    last = last.where("part_name <> ''").groupBy(*DESIGN, "part_name").agg(F.max("head").alias("head"))
    own = by_name.join(last, [*DESIGN, "part_name", "head"]).where("pin <> ''")
    return values, own.groupBy(*DESIGN, "part_name", "pin").agg(F.max_by("pin_name", "place").alias("pin_name"))
