"""Altium schematics: sheets become record rows, joins and a spatial join make them a netlist.

``records`` has design_id, sheet, sheet_ord, idx (place among the sheet's records), kind (record type), owner (idx of
the record that owns it; null for roots) and props (all fields). Every step below is over any number of sheets.
Field names come in several casings; ``field`` takes the first that is there, ``filled_field`` the first not empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators import geometry
from copperline.operators.xnet import cut
from copperline.plans.netlist import Netlist
from copperline.sources.files import opened
from copperline.sources.ole import CompoundFile, OleError

# Record types of the format.
COMPONENT, PIN, POWER_PORT, NET_LABEL, WIRE, DESIGNATOR, PARAMETER = "1", "2", "17", "25", "27", "34", "41"
RECORD_NAMES = {
    "0": "Header", "1": "Component", "2": "Pin", "3": "IEEE Symbol", "4": "Label", "5": "Bezier", "6": "Polyline", "7": "Polygon", "8": "Ellipse",
    "9": "Piechart", "10": "Round Rectangle", "11": "Elliptical Arc", "12": "Arc", "13": "Line", "14": "Rectangle", "15": "Sheet Symbol",
    "16": "Sheet Entry", "17": "Power Port", "18": "Port", "22": "No ERC", "25": "Net Label", "26": "Bus", "27": "Wire", "28": "Text Frame",
    "29": "Junction", "30": "Image", "31": "Sheet", "32": "Sheet Name", "33": "Sheet File Name", "34": "Designator", "37": "Bus Entry",
    "39": "Template", "41": "Parameter", "43": "Warning Sign", "44": "Implementation List", "45": "Implementation", "46": "Implementation Pin",
    "47": "Implementation Param", "48": "Implementation Map", "226": "Hyperlink",
}
PIN_ELECTRICAL = ["INPUT", "IO", "OUTPUT", "OPEN_COLLECTOR", "PASSIVE", "HI_Z", "OPEN_EMITTER", "POWER"]
PORT_STYLES = ["CIRCLE", "ARROW", "BAR", "WAVE", "POWER_GROUND", "SIGNAL_GROUND", "EARTH", "GOST_ARROW", "GOST_POWER_GROUND", "GOST_EARTH", "GOST_BAR"]
CONNECTABLE = [WIRE, PIN, NET_LABEL, POWER_PORT]
#: Units of a whole coordinate.
SCALE = 10_000
LEAD, TRAIL = 5, 1  # bytes around the records of a stream
BETWEEN = b"\x00\x00|"  # after the three length bytes of the next record
#: Records that leave a task at once.
BATCH_RECORDS = 4096

SHEET = ["design_id", "sheet"]
RECORDS = "design_id string, sheet string, sheet_ord int, idx long, kind string, owner long, props map<string,string>"


def record_pieces(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The records of a stream that comes in pieces, without the bytes around and between them; the last may be empty."""
    held, begun = b"", False
    for chunk in chunks:
        held += chunk
        if not begun:
            if len(held) < LEAD:
                continue
            held, begun = held[LEAD:], True
        # A record ends where the next mark begins; the stream's last bytes may be part of a mark, or trail it.
        whole = held[: len(held) - TRAIL]
        *records, rest = whole.split(BETWEEN)
        for record in records:
            yield record[:-3]
        held = rest + held[len(held) - TRAIL :]
    if begun:
        yield held[: len(held) - TRAIL]


def record_stream(chunks: Iterable[bytes]) -> Iterator[dict[str, str]]:
    """The fields of each record of a stream, headers included; values keep their blanks and may hold =."""
    for piece in record_pieces(chunks):
        pairs = (x.partition("=") for x in piece.decode("utf-8", "replace").split("|"))
        if fields := {k.strip(): v for k, equals, v in pairs if equals and k.strip()}:
            yield fields


def record_fields(stream: bytes) -> list[dict[str, str]]:
    return list(record_stream([stream]))


def _whole(text: str | None) -> int | None:
    """The leading integer of a text, as the source tools read it."""
    digits = (text or "").strip()
    sign = digits[:1] if digits[:1] in ("-", "+") else ""
    n = 0
    while len(sign) + n < len(digits) and digits[len(sign) + n].isdecimal():
        n += 1
    return int(digits[: len(sign) + n]) if n else None


Record = tuple[int, str, int | None, list[tuple[str, str]]]


def record_batches(chunks: Iterable[bytes]) -> Iterator[list[Record]]:
    """(idx, kind, owner, props) of each record, in batches; owners out of range make a root.

    A record whose owner stands behind it waits for the number of records, others go on at once.
    """
    rows: list[Record] = []
    waiting: list[Record] = []
    idx = -1
    for idx, fields in enumerate(f for f in record_stream(chunks) if "RECORD" in f):
        owner = _whole(fields.get("OwnerIndex", fields.get("OWNERINDEX")))
        row = (idx, fields["RECORD"], owner if owner is not None and owner >= 0 else None, list(fields.items()))
        (waiting if owner is not None and owner > idx else rows).append(row)
        if len(rows) >= BATCH_RECORDS:
            yield rows
            rows = []
    rows += [(k, kind, owner if owner <= idx else None, props) for k, kind, owner, props in waiting]
    if rows:
        yield rows


def record_rows(stream: bytes) -> list[Record]:
    """All records of a stream, in their order."""
    return sorted((row for rows in record_batches([stream]) for row in rows), key=lambda r: r[0])


def read_records(design: str, sheet: str, order: int, source) -> Iterator[pa.RecordBatch]:
    """Record rows of one sheet, in batches."""
    try:
        for rows in record_batches(CompoundFile(source).pieces("FileHeader")):
            idx, kinds, owners, props = zip(*rows, strict=True)
            n = len(rows)
            columns = [pa.array([design] * n, pa.string()), pa.array([sheet] * n, pa.string()), pa.array([order] * n, pa.int32()), pa.array(idx, pa.int64()), pa.array(kinds, pa.string()), pa.array(owners, pa.int64()), pa.array(props, pa.map_(pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RECORDS.split(", ")])
    except OleError as e:
        raise OleError(f"{sheet}: {e}") from e


def records(sheets: DataFrame) -> DataFrame:
    """Record rows of sheets given as (design_id, sheet, sheet_ord, content); a sheet that can't be read raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for design, sheet, order, content in zip(*(batch.column(k) for k in range(4)), strict=True):
                yield from read_records(design.as_py(), sheet.as_py(), order.as_py(), content.as_py() or b"")

    return sheets.select("design_id", "sheet", F.col("sheet_ord").cast("int"), "content").mapInArrow(run, RECORDS)


def file_records(sheets: DataFrame) -> DataFrame:
    """Record rows of sheets given as (design_id, sheet, sheet_ord), ``sheet`` being a file's path; missing files give none.

    A task seeks in the file for the sectors of its record stream, so a sheet of any size takes little memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for design, sheet, order in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    source = opened(sheet)
                except (FileNotFoundError, IsADirectoryError):
                    continue
                with source:
                    yield from read_records(design, sheet, order, source)

    return sheets.select("design_id", "sheet", F.col("sheet_ord").cast("int")).mapInArrow(run, RECORDS)


def field(props: str, *names: str) -> Column:
    return F.coalesce(*[F.col(props)[n] for n in names])


def filled_field(props: str, *names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(props)[n], F.lit("")) for n in names])


# --- views and record operators -------------------------------------------------------------------------------


def hierarchy(rows: DataFrame) -> DataFrame:
    """Records with the kind and fields of their owner, and whether they are roots."""
    own = rows.select(*SHEET, F.col("idx").alias("owner"), F.col("kind").alias("owner_kind"), F.col("props").alias("owner_props"), F.col("owner").alias("owner_owner"))
    return rows.join(own, [*SHEET, "owner"], "left").withColumn("is_root", F.col("owner").isNull())


def flattened(rows: DataFrame) -> DataFrame:
    """Records with ``path``, the idx of each record from their root down: its order is the depth-first order.

    Each round puts the path of the topmost record met so far before one's own, so depth doubles. Rounds move keys and
    paths alone, of the records that have not met their root. A cycle of owners raises ValueError.
    """
    owned = rows.where(F.col("owner").isNotNull()).select(*SHEET, "idx", F.array("idx").alias("path"), F.col("owner").alias("up"))
    open_, found = cut(owned), []
    while not open_.isEmpty():
        above = open_.select(*SHEET, F.col("idx").alias("up"), F.col("path").alias("upper"), F.col("up").alias("further"))
        for f in found:  # an owner that met its root has its whole path
            above = above.unionByName(f.select(*SHEET, F.col("idx").alias("up"), F.col("path").alias("upper"), F.lit(None).cast("long").alias("further")))
        met = open_.join(above, [*SHEET, "up"], "left")
        path = F.concat(F.coalesce("upper", F.array("up")), "path")
        out = cut(met.select(*SHEET, "idx", path.alias("path"), F.col("further").alias("up")))
        if not out.where(F.size("path") > F.size(F.array_distinct("path"))).isEmpty():
            raise ValueError("records own one another in a cycle")
        found.append(out.where(F.col("up").isNull()).drop("up"))
        open_ = out.where(F.col("up").isNotNull())
    paths = found[0] if found else owned.drop("up")
    for more in found[1:]:
        paths = paths.unionByName(more)
    with_path = rows.join(paths.withColumnRenamed("path", "owned_path"), [*SHEET, "idx"], "left")
    return with_path.withColumn("path", F.coalesce("owned_path", F.array("idx"))).drop("owned_path")


def parts_list(rows: DataFrame) -> DataFrame:
    """Components that are roots."""
    return rows.where((F.col("kind") == COMPONENT) & F.col("owner").isNull())


def find_records(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col("props")[key] == value)


def record_view(rows: DataFrame, view: str = "all-hierarchy") -> DataFrame:
    """One of the four output shapes: all-list, all-hierarchy, parts-list, net-list."""
    views = {"all-list": lambda: rows, "parts-list": lambda: parts_list(rows), "net-list": lambda: named_groups(rows)}
    return views.get(view, lambda: hierarchy(rows))()


#: The field that records of a type must have, be it empty; other types need only their type.
REQUIRED = {DESIGNATOR: "Text", PARAMETER: "Name", POWER_PORT: "Text", NET_LABEL: "Text"}


def _faults() -> list[Column]:
    """What a record lacks by its type's rules, null where it is fine."""
    kind, props = F.col("kind"), F.col("props")
    missing = [F.when((kind == k) & props[f].isNull(), F.lit(f"{f} is missing")) for k, f in REQUIRED.items()]
    return [*missing, F.when((kind == DESIGNATOR) & (props["Name"] != "Designator"), F.lit("Name is not Designator"))]


def valid_records(rows: DataFrame, kind: str) -> Column:
    """Whether a record is of that type and has what the type must have."""
    return (F.col("kind") == kind) & F.coalesce(*_faults()).isNull()


def record_faults(rows: DataFrame) -> DataFrame:
    """(sheet key, idx, kind, fault): a row for each rule of its type that a record breaks."""
    return rows.select(*SHEET, "idx", "kind", F.explode(F.array_compact(F.array(*_faults()))).alias("fault"))


# --- parts ------------------------------------------------------------------------------------------------------


def _pin_fits(pin: str, part: str) -> Column:
    """A pin belongs to the part that is shown, if both say which part they are."""
    own, shown = field(pin, "OwnerPartId", "OWNERPARTID"), field(part, "CURRENTPARTID", "CurrentPartId", "CurrentPartID")
    return F.coalesce(F.nullif(own, F.lit("")) == F.nullif(shown, F.lit("")), F.lit(True))


def pin_number(props: str = "props") -> Column:
    return filled_field(props, "Designator", "DESIGNATOR", "Name", "NAME")


def designators(rows: DataFrame) -> DataFrame:
    """(sheet key, owner, refdes): the text of the first designator of each record, null if that is empty; and the first not empty."""
    text = F.nullif(field("props", "Text", "TEXT", "Name", "NAME"), F.lit(""))
    own = rows.where((F.col("kind") == DESIGNATOR) & F.col("owner").isNotNull()).withColumn("text", text)
    entry = F.struct("idx", "text")
    return own.groupBy(*SHEET, "owner").agg(F.min(entry).getField("text").alias("refdes"), F.min(F.when(F.col("text").isNotNull(), entry)).getField("text").alias("any_refdes"))


def components(rows: DataFrame) -> DataFrame:
    """(sheet key, sheet_ord, part, refdes, mpn, description, comment, value): each part with a designator; of equal refdes on a sheet the last."""
    parameters = rows.where((F.col("kind") == PARAMETER) & F.col("owner").isNotNull())
    parameters = parameters.select(*SHEET, "owner", "idx", field("props", "Name", "NAME").alias("name"), field("props", "Text", "TEXT").alias("text"))
    parameters = parameters.where("name <> '' AND text <> ''").withColumns({"name": exprs.trimmed(F.col("name")), "text": exprs.trimmed(F.col("text"))}).where("name <> ''")
    named = lambda n: F.max(F.when(F.col("name") == n, F.struct("idx", "text"))).getField("text")
    lists = parameters.groupBy(*SHEET, "owner").agg(named("Manufacturer Part Number").alias("p_mpn"), named("Comment").alias("p_comment"))
    latest = parameters.groupBy(*SHEET, "owner", F.lower("name").alias("key")).agg(F.max_by("text", "idx").alias("text"))
    lookup = latest.groupBy(*SHEET, "owner").agg(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("p_all"))

    rows = parts_list(rows).drop("owner").withColumnRenamed("idx", "owner").join(designators(rows), [*SHEET, "owner"]).where("refdes IS NOT NULL")
    rows = rows.join(lists, [*SHEET, "owner"], "left").join(lookup, [*SHEET, "owner"], "left")
    mpn = F.coalesce(F.nullif("p_mpn", F.lit("")), filled_field("props", "PartNumber", "Mpn", "PARTNUMBER", "MPN"))
    said = exprs.filled(F.col("p_comment"))
    link = exprs.filled(F.expr("substring(said, 2)"))
    looked = exprs.filled(F.when(link.isNotNull(), F.try_element_at("p_all", F.lower(link))))
    value = exprs.filled(F.try_element_at("p_all", F.lit("value")))
    rows = rows.withColumns({"mpn": mpn, "said": said, "value": value}).withColumn("comment", F.when(F.startswith("said", F.lit("=")), looked).otherwise(F.col("said")))
    rows = rows.withColumn("comment", F.nullif("comment", "value"))
    description = filled_field("props", "ComponentDescription", "Description", "DESCRIPTION")
    own = rows.select(*SHEET, "sheet_ord", F.col("owner").alias("part"), "refdes", "mpn", description.alias("description"), "comment", "value")
    last = Window.partitionBy(*SHEET, "refdes")
    return own.withColumns({"latest": F.max("part").over(last), "first": F.min("part").over(last)}).where("part = latest").drop("latest")


def component_pins(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(sheet key, refdes, pin, pin_name, pin_ord) of the parts' own pins; of equal numbers the last."""
    pins = rows.where((F.col("kind") == PIN) & F.col("owner").isNotNull())
    own = parts.select(*SHEET, F.col("part").alias("owner"), "refdes")
    about = rows.select(*SHEET, F.col("idx").alias("owner"), F.col("props").alias("part_props"))
    joined = pins.join(own, [*SHEET, "owner"]).join(about, [*SHEET, "owner"]).where(_pin_fits("props", "part_props"))
    name = F.nullif(field("props", "Name", "NAME"), F.lit(""))
    named = joined.select(*SHEET, "refdes", pin_number().alias("pin"), name.alias("name"), "idx").where("pin IS NOT NULL")
    made = named.groupBy(*SHEET, "refdes", "pin").agg(F.max(F.struct("idx", "name")).getField("name").alias("name"), F.min("idx").alias("pin_ord"))
    return made.select(*SHEET, "refdes", "pin", exprs.pin_name(F.col("pin"), F.col("name")).alias("pin_name"), "pin_ord")


# --- nets -------------------------------------------------------------------------------------------------------


def scaled(base: Column, fraction: Column) -> Column:
    number = lambda c: F.coalesce(F.when(F.isnan(c.try_cast("double")), None).otherwise(c.try_cast("double")), F.lit(0.0))
    return F.floor(number(base) * SCALE + number(fraction) + 0.5).cast("long")


def _location(axis: str) -> Column:
    return scaled(field("props", f"Location.{axis}", f"LOCATION.{axis}"), field("props", f"Location.{axis}_Frac", f"LOCATION.{axis}_FRAC"))


def devices(rows: DataFrame) -> DataFrame:
    """Records that connect, with their points and, for ports and labels, the name that connects them anywhere on the sheet.

    Pins of a part that is not shown are left out. A pin runs from its place along one of four directions for its
    length, a wire through its numbered corners, a port or label is a point.
    """
    own = rows.where(F.col("kind").isin(CONNECTABLE))
    about = rows.select(*SHEET, F.col("idx").alias("owner"), F.col("props").alias("owner_props"))
    own = own.join(about, [*SHEET, "owner"], "left").where((F.col("kind") != PIN) | F.col("owner_props").isNull() | _pin_fits("props", "owner_props"))
    x, y = _location("X"), _location("Y")
    length = scaled(field("props", "PinLength", "PINLENGTH"), field("props", "PinLength_Frac", "PINLENGTH_FRAC"))
    flags = F.regexp_extract(F.coalesce(filled_field("props", "PinConglomerate", "PINCONGLOMERATE"), F.lit("0")), r"^\s*([+-]?\d+)", 1).try_cast("long")
    turn = F.coalesce(flags.bitwiseAND(F.lit(3)), F.lit(0))
    tip_x = x + F.when(turn == 0, length).when(turn == 2, -length).otherwise(0)
    tip_y = y + F.when(turn == 1, length).when(turn == 3, -length).otherwise(0)
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array_sort(F.transform(F.filter(F.map_keys("props"), lambda k: k.rlike(r"^X\d+\z")), lambda k: F.substring(k, 2, 9).cast("int")))
    at = lambda axis, n: scaled(F.col("props")[F.concat(F.lit(axis), n)], F.coalesce(F.col("props")[F.concat(F.lit(axis), n, F.lit("_Frac"))], F.col("props")[F.concat(F.lit(axis), n, F.lit("_FRAC"))]))
    wire = F.transform(corners, lambda n: point(at("X", n.cast("string")), at("Y", n.cast("string"))))
    points = F.when(F.col("kind") == PIN, F.array(point(x, y), point(tip_x, tip_y))).when(F.col("kind") == WIRE, wire).otherwise(F.array(point(x, y)))
    text = F.when(F.col("kind").isin(POWER_PORT, NET_LABEL), F.nullif(field("props", "Text", "TEXT"), F.lit("")))
    order = F.struct(F.coalesce("owner", "idx").alias("root"), F.when(F.col("owner").isNull(), -1).otherwise(F.col("idx")).alias("child"))
    return own.select(*SHEET, "sheet_ord", "idx", "kind", "owner", "props", points.alias("points"), text.alias("label"), order.alias("device_ord"))


def _pin_rank(pin: Column) -> Column:
    """Order of pin numbers: by leading number, then the others in collated order."""
    number = F.regexp_extract(pin, r"^\s*[+-]?\d+", 0)
    value = F.nullif(number, F.lit("")).try_cast("long")
    return F.struct(value.isNull().alias("c"), value.alias("n"), F.when(value.isNull(), exprs.collated(pin)).alias("s"))


def named_groups(rows: DataFrame) -> DataFrame:
    """Devices with their connected group and its name: the first label or port, else made of its least pin; null without either."""
    found = cut(devices(rows))
    groups = geometry.connected_groups(found, SHEET, cut)
    all_ = found.join(groups, [*SHEET, "idx"]).join(designators(rows), [*SHEET, "owner"], "left")
    number = F.coalesce(F.nullif(field("props", "Designator", "DESIGNATOR"), F.lit("")), F.nullif(field("props", "Name", "NAME"), F.lit("")))
    all_ = all_.withColumn("number", F.when(F.col("kind") == PIN, number))
    least = F.when(F.col("any_refdes").isNotNull() & F.col("number").isNotNull(), F.struct(exprs.collated(F.col("any_refdes")).alias("r"), _pin_rank(F.col("number")).alias("p"), F.col("any_refdes").alias("refdes"), F.col("number").alias("pin")))
    names = all_.groupBy(*SHEET, "group").agg(
        F.min(F.when(F.col("label").isNotNull(), F.struct("idx", "label"))).getField("label").alias("label_name"),
        F.min(least).alias("least"),
        F.min("device_ord").alias("group_ord"),
        F.count(F.when(F.col("kind") == PIN, 1)).alias("n_pins"),
        F.count("*").alias("n_devices"),
    )
    derived = F.concat(F.lit("Net"), F.col("least.refdes"), F.lit("_"), F.col("least.pin"))
    names = names.withColumn("name", F.coalesce("label_name", derived)).drop("label_name", "least")
    return all_.join(names, [*SHEET, "group"])


def sheet_nets(rows: DataFrame) -> DataFrame:
    """(sheet key, sheet_ord, net, refdes, pin, orders): pins of each named group, lone pins left out; of equal names on a sheet the last."""
    pins = named_groups(rows).where((F.col("kind") == PIN) & ~((F.col("n_pins") == 1) & (F.col("n_devices") == 1)))
    pins = pins.withColumn("pin", pin_number()).where("refdes IS NOT NULL AND pin IS NOT NULL AND name IS NOT NULL")
    same = Window.partitionBy(*SHEET, "name")
    kept = pins.withColumns({"latest": F.max("group_ord").over(same), "net_first": F.min("group_ord").over(same)}).where("group_ord = latest")
    return kept.groupBy(*SHEET, "sheet_ord", F.col("name").alias("net"), "refdes", "pin").agg(F.min("idx").alias("idx"), F.first("net_first").alias("net_first"))


def netlist(sheets: DataFrame) -> Netlist:
    """The netlist of all designs whose sheets are given as (design_id, sheet, sheet_ord, content)."""
    return netlist_of_records(records(sheets))


def file_netlist(sheets: DataFrame) -> Netlist:
    """The netlist of all designs whose sheets are files, given as (design_id, sheet, sheet_ord)."""
    return netlist_of_records(file_records(sheets))


def _chosen(parts: DataFrame) -> DataFrame:
    """Of a part on several sheets the first."""
    first = Window.partitionBy("design_id", "refdes").orderBy("sheet_ord", "sheet")
    return parts.withColumn("n", F.row_number().over(first)).where("n = 1")


def _described(chosen: DataFrame) -> DataFrame:
    comp_ord = F.row_number().over(Window.partitionBy("design_id").orderBy("sheet_ord", "first")) - 1
    return chosen.select("design_id", "refdes", "mpn", F.col("mpn").isNotNull().alias("mpn_present"), "description", "comment", "value", comp_ord.cast("long").alias("comp_ord"))


def design_components(rows: DataFrame) -> DataFrame:
    """The components table of all designs whose records are given, without the work that nets take."""
    return _described(_chosen(components(cut(rows.where(F.col("kind").isin(COMPONENT, DESIGNATOR, PARAMETER))))))


def netlist_of_records(rows: DataFrame) -> Netlist:
    """The netlist of all designs whose records are given.

    Nets of one name join across the sheets of a design; of a component on several sheets the first counts. Its
    pins name the last of the sheet's nets that holds them.
    """
    rows = cut(rows)
    parts = components(rows)
    nets = cut(sheet_nets(rows))
    spot = F.struct("sheet_ord", "net_first", "idx")

    net_key, ref_key = ["design_id", "net"], ["design_id", "net", "refdes"]
    merged = nets.groupBy(*ref_key, "pin").agg(F.min(spot).alias("at"))
    by_net, by_ref = Window.partitionBy(*net_key), Window.partitionBy(*ref_key)
    merged = merged.withColumns({"net_at": F.min("at").over(by_net), "ref_at": F.min("at").over(by_ref)})
    rank = lambda group, order: F.dense_rank().over(Window.partitionBy(*group).orderBy(order)) - 1
    net_pins = merged.select("design_id", "net", "refdes", "pin", rank(["design_id"], "net_at").alias("net_ord"), rank(net_key, "ref_at").alias("ref_ord"), rank(ref_key, "at").alias("pin_ord"))

    own = component_pins(rows, parts)
    key_ord = exprs.map_order(F.col("net"), F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("net_first")).cast("bigint"))
    last = nets.withColumn("key_ord", key_ord).join(parts.select(*SHEET, "refdes"), [*SHEET, "refdes"]).groupBy(*SHEET, "refdes", "pin").agg(F.max_by("net", "key_ord").alias("net"), F.min("idx").alias("met"))
    pins = own.join(last, [*SHEET, "refdes", "pin"], "full_outer")
    pins = pins.select(*SHEET, "refdes", "pin", "pin_name", F.coalesce("net", F.lit("")).alias("net"), F.struct(F.col("pin_ord").isNull().alias("late"), F.coalesce("pin_ord", "met").alias("o")).alias("spot"))

    chosen = _chosen(parts)
    comps = _described(chosen)
    place = F.row_number().over(Window.partitionBy("design_id", "refdes").orderBy("spot")) - 1
    kept = pins.join(chosen.select("design_id", "sheet", "refdes"), [*SHEET, "refdes"], "left_semi")
    comp_pins = kept.select("design_id", "refdes", "pin", "pin_name", "net", place.alias("pin_ord"))
    return Netlist(comps, comp_pins, net_pins, net_pins.select("design_id", "net", "net_ord").distinct()).checked()
