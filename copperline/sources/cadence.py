"""Cadence text exports: three files per design become staging rows, joins make them a netlist.

The readers here take a file's text as a whole, for contents that are rows already (streams, small files); ``splits`` reads
files of any size and gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators.ordering import numbered
from copperline.operators.xnet import cut
from copperline.plans.netlist import Netlist
from copperline.sources import splits

#: What the source tools trim: white space of any script and the byte order mark.
_SPACE = " \t\n\r\x0b\x0c\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_WORDS = re.compile(f"[{_SPACE}]+")
_PART_LINE = re.compile(f"([^{_SPACE}]+)[{_SPACE}]+'([^']+)'")
_PRIMITIVE = re.compile(f"primitive[{_SPACE}]+'([^']+)'")
_PIN_LINE = re.compile(r"'([^']+)':")


def key_order(keys: list[str]) -> list[str]:
    """Keys as objects of the source tools list them: array indexes by value, then the others as they came."""
    index = [k for k in keys if re.fullmatch(r"0|[1-9][0-9]{0,9}", k) and int(k) < 4294967295]
    return sorted(index, key=int) + [k for k in keys if k not in set(index)]


def _sections(text: str, header: str) -> list[list[str]]:
    """Trimmed lines between header lines; the first section is what stands before any header."""
    out: list[list[str]] = [[]]
    for line in (raw.strip(_SPACE) for raw in text.split("\n")):
        if line == header:
            out.append([])
        else:
            out[-1].append(line)
    return out


def net_rows(text: str) -> list[tuple[str, int, str | None, int | None, str | None, int | None]]:
    """(net, net_ord, refdes, ref_ord, pin, pin_ord); a net without nodes has one row of nulls. A repeated net replaces the earlier one."""
    nets: dict[str, dict[str, list[str]]] = {}
    for lines in _sections(text, "NET_NAME"):
        name = next((x[1:-1] for x in lines if x.startswith("'") and x.endswith("'")), None)
        if name is None:
            continue
        nodes: dict[str, list[str]] = {}
        for words in (_WORDS.split(x) for x in lines if x.startswith("NODE_NAME")):
            if len(words) >= 3:
                nodes.setdefault(words[1], []).append(words[2])
        nets[name] = nodes
    rows: list[tuple] = []
    for n, net in enumerate(key_order(list(nets))):
        if not nets[net]:
            rows.append((net, n, None, None, None, None))
        for r, refdes in enumerate(key_order(list(nets[net]))):
            rows += [(net, n, refdes, r, pin, p) for p, pin in enumerate(nets[net][refdes])]
    return rows


def _properties(lines: list[str], quotes: str) -> dict[str, str]:
    found = {}
    for key, equals, value in (x.partition("=") for x in lines):
        if equals:
            value = value.strip(_SPACE)
            found[key.strip(_SPACE)] = (value[1:] if value[:1] in ("'", '"') else value).rstrip(quotes)
    return found


def part_rows(text: str) -> list[tuple[str, int, str | None, str | None, str | None]]:
    """(refdes, comp_ord, part_name, mpn, description); a repeated refdes replaces the earlier one."""
    parts: dict[str, tuple[str | None, str | None, str | None]] = {}
    names: dict[str, str] = {}
    for lines in _sections(text, "PART_NAME"):
        head = next((k for k, x in enumerate(lines) if " " in x and x.endswith((":", ":;"))), None)
        if head is None:
            continue
        match = _PART_LINE.match(lines[head])
        refdes, part = match.groups() if match else (lines[head].split(" ")[0], None)
        own = _properties(lines[head + 1 :], "'\";,")
        parts[refdes] = (part, own.get("MFGR_PN") or part or None, own.get("DESCR") or None)
        if part:
            names[refdes] = part
    return [(refdes, k, names.get(refdes), parts[refdes][1], parts[refdes][2]) for k, refdes in enumerate(key_order(list(parts)))]


def _chip(lines: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """(pins: name to number, body) of one primitive. Blocks open at the lines pin and body; end_pin; closes a pin block only."""
    pins: dict[str, str] = {}
    body: dict[str, str] = {}
    marks = [k for k, x in enumerate(lines) if x in ("pin", "body", "end_pin;")]
    kind = ""
    for start, end in zip(marks, [*marks[1:], len(lines)], strict=False):
        if lines[start] != "end_pin;":
            kind = lines[start]
        elif kind == "pin":
            kind = ""
        block = lines[start + 1 : end]
        if kind == "body":
            body |= _properties(block, "'\";")
        elif kind == "pin":
            name = None
            for line in block:
                if line.startswith("'") and ":" in line:
                    name = match[1] if (match := _PIN_LINE.search(line)) else name
                elif name and "PIN_NUMBER" in line and "=" in line:
                    pins[name] = line.split("=")[1].strip(_SPACE).strip("'\";()")
    return pins, body


def chip_rows(text: str) -> list[tuple[str, int, dict[str, str], dict[str, str]]]:
    """(part_name, chip_ord, pins: name to number, body) of each primitive, in order."""
    lines = [raw.strip(_SPACE) for raw in text.split("\n")]
    heads = [k for k, x in enumerate(lines) if x.startswith("primitive ")]
    found = [(_PRIMITIVE.search(lines[k]), lines[k + 1 : end]) for k, end in zip(heads, [*heads[1:], len(lines)], strict=False)]
    named = [(match[1], *_chip(own)) for match, own in found if match]
    return [(name, k, pins, body) for k, (name, pins, body) in enumerate(named)]


def _parsed(files: DataFrame, kind: str, parse, fields: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """design_id and the rows that parse gives for each file's text; files are rows (design_id, kind, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for design, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if rows := parse((content.as_py() or b"").decode("utf-8", "replace")):
                    columns = [pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([design] * len(rows), pa.string()), *columns], names=["design_id", *(n for n, _ in fields)])

    return files.where(F.col("kind") == kind).select("design_id", "content").mapInArrow(run, f"design_id string, {ddl}")


def stage_nets(files: DataFrame) -> DataFrame:
    s, n = pa.string(), pa.int64()
    return _parsed(files, "pstxnet", net_rows, [("net", s), ("net_ord", n), ("refdes", s), ("ref_ord", n), ("pin", s), ("pin_ord", n)], "net string, net_ord long, refdes string, ref_ord long, pin string, pin_ord long")


def stage_parts(files: DataFrame) -> DataFrame:
    s = pa.string()
    return _parsed(files, "pstxprt", part_rows, [("refdes", s), ("comp_ord", pa.int64()), ("part_name", s), ("mpn", s), ("description", s)], "refdes string, comp_ord long, part_name string, mpn string, description string")


def stage_chips(files: DataFrame) -> DataFrame:
    m = pa.map_(pa.string(), pa.string())
    pairs = lambda text: [(a, b, list(c.items()), list(d.items())) for a, b, c, d in chip_rows(text)]
    return _parsed(files, "pstchip", pairs, [("part_name", pa.string()), ("chip_ord", pa.int64()), ("pins", m), ("body", m)], "part_name string, chip_ord long, pins map<string,string>, body map<string,string>")


def netlist(files: DataFrame) -> Netlist:
    """The netlist of all designs whose three files are given as rows (design_id, kind, content), each read by one task."""
    chips = stage_chips(files)
    values = chips.withColumn("chip_value", F.col("body")["VALUE"]).where("chip_value <> ''").groupBy("design_id", "part_name").agg(F.max_by("chip_value", "chip_ord").alias("chip_value"))
    last = chips.groupBy("design_id", "part_name").agg(F.max_by("pins", "chip_ord").alias("pins"))
    names = last.select("design_id", "part_name", F.posexplode(F.map_entries("pins")).alias("place", "e")).where("e.value <> ''")
    names = names.groupBy("design_id", "part_name", F.col("e.value").alias("pin")).agg(F.max_by("e.key", "place").alias("pin_name"))
    return joined(stage_nets(files), stage_parts(files), values, names)


def split_netlist(wanted: DataFrame, split: int = splits.SPLIT) -> Netlist:
    """The netlist of all designs whose three files are named by rows (design_id, kind, path); each file is read in splits."""
    return netlist_of_lines(splits.read_lines(wanted, split))


def netlist_of_lines(lines: DataFrame) -> Netlist:
    """The netlist of designs whose files are given as lines, as ``splits`` has them. Lines are read once, the steps read what was kept of them."""
    lines = cut(lines)
    return joined(splits.nets(lines), splits.parts(lines), *splits.chips(lines))


def joined(nets: DataFrame, parts: DataFrame, values: DataFrame, names: DataFrame) -> Netlist:
    """The netlist of what was read of the three files.

    Node references that are no reference designators stay in the nets and make no component. A valid one that
    the part list lacks becomes a component without properties. Pin names come from the part's last definition,
    its VALUE from the last definition that has one, for parts that some net holds.
    """
    nets = cut(nets)
    nodes = nets.where("refdes IS NOT NULL")
    valid = nodes.where(exprs.is_refdes(F.col("refdes")))
    spot = F.struct("net_ord", "ref_ord", "pin_ord")
    pins = cut(valid.groupBy("design_id", "refdes", "pin").agg(F.max_by("net", spot).alias("net"), F.min(spot).alias("first")))
    held = pins.groupBy("design_id", "refdes").agg(F.min("first").alias("met"))

    rows = parts.withColumn("known", F.lit(True)).join(held, ["design_id", "refdes"], "full_outer").join(values, ["design_id", "part_name"], "left")
    late = {"o_kind": F.when(F.col("known"), 0).otherwise(1), "o_place": F.coalesce("comp_ord", F.col("met.net_ord")), "o_ref": F.coalesce(F.col("met.ref_ord"), F.lit(0))}
    rows = numbered(cut(rows.withColumns(late).drop("comp_ord")), ["design_id"], list(late), "comp_ord", cut)
    known = F.coalesce("known", F.lit(False))
    components = rows.select("design_id", "refdes", "mpn", known.alias("mpn_present"), "description", F.lit(None).cast("string").alias("comment"), F.when(F.col("met").isNotNull(), F.col("chip_value")).alias("value"), "comp_ord")

    pins = numbered(pins, ["design_id", "refdes"], ["first"], "pin_ord", cut)
    pins = pins.join(parts.select("design_id", "refdes", "part_name"), ["design_id", "refdes"], "left").join(names, ["design_id", "part_name", "pin"], "left")
    component_pins = pins.select("design_id", "refdes", "pin", exprs.pin_name(F.col("pin"), F.col("pin_name")).alias("pin_name"), "net", "pin_ord")

    net_pins = nodes.select("design_id", "net", "refdes", "pin", "net_ord", "ref_ord", "pin_ord")
    return Netlist(components, component_pins, net_pins, nets.select("design_id", "net", "net_ord").distinct()).checked()
