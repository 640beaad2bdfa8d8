"""The projection as files: schematic sheets, and listings of fleets of designs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copperline.operators import xnet
from copperline.plans.projection import ranked_pins, refdes_of
from copperline.sources import altium, writer
from copperline.sources.files import located
from copperline.sources.listing import OLE_MAGIC, as_listing

# Fixed distances of the drawn sheets, in whole units: parts, pins of a part, a pin's length and a wire's reach.
PART_STEP, PIN_STEP, PIN_LENGTH, WIRE_END = 100, 20, 4, 50
#: Parts that are taken out of an Arrow batch at once.
PARTS = 512


def drawn_part(at: int, place: int, refdes: str, mpn: str | None, name: str, kind: str, size: str, pins: list[tuple[str, str]]) -> list[dict[str, str]]:
    """Records of a part that stands at record ``at`` and in column ``place`` of its sheet.

    Pins point in the four directions in turn. Pins of J parts end in a wire that nothing names, those of FB parts end
    nowhere, others carry a label with their net, and those on GND a wire to a power port. U parts hold a pin of a
    part that is not shown.
    """
    own = {"OwnerIndex": str(at)}
    rows = [{"RECORD": "1", "CurrentPartId": "1", "ComponentDescription": name}, {"RECORD": "34", **own, "Text": refdes}]
    said = [("Manufacturer Part Number", mpn)] if mpn else []
    rows += [{"RECORD": "41", **own, "Name": n, "Text": t} for n, t in [*said, ("Comment", "=Kind"), ("Kind", kind), ("Value", size)]]
    spot = lambda x, y: {"Location.X": str(x), "Location.Y": str(y), "Location.X_Frac": "2500"}
    after = []
    for pin, net in sorted(pins, key=lambda p: int(p[0])):
        n = int(pin)
        x, y, turn = place * PART_STEP, n * PIN_STEP, n % 4
        rows.append({"RECORD": "2", **own, "OwnerPartId": "1", "Designator": pin, "Name": f"IO{pin}", **spot(x, y), "PinLength": str(PIN_LENGTH), "PinConglomerate": str(turn)})
        x, y = x + (PIN_LENGTH, 0, -PIN_LENGTH, 0)[turn], y + (0, PIN_LENGTH, 0, -PIN_LENGTH)[turn]
        far = place * PART_STEP + WIRE_END
        wire = {"RECORD": "27", "X1": str(x), "Y1": str(y), "X1_Frac": "2500", "X2": str(far), "Y2": str(y)}
        if refdes.startswith("J"):
            after.append(wire)
        elif net == "GND" and not refdes.startswith("FB"):
            after += [wire, {"RECORD": "17", "Text": net, "Location.X": str(far), "Location.Y": str(y)}]
        elif not refdes.startswith("FB"):
            after.append({"RECORD": "25", "Text": net, **spot(x, y)})
    if refdes.startswith("U"):
        rows.append({"RECORD": "2", **own, "OwnerPartId": "2", "Designator": "99", "Name": "HIDDEN", **spot(place * PART_STEP, 0), "PinLength": str(PIN_LENGTH)})
    return rows + after


def drawn_records(kind: str, parts: Iterable[dict]) -> Iterator[dict[str, str]]:
    """Records of a sheet's parts, a part at a time: a sheet holds as many parts as its brand and type have."""
    at = 0
    for place, p in enumerate(parts):
        rows = drawn_part(at, place, p["refdes"], p["mpn"], p["name"], kind, p["size"], [(x["pin"], x["net"]) for x in p["pins"] or ()])
        at += len(rows)
        yield from rows


def altium_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the projection drawn as schematic sheets, a design per brand and a sheet per part type.

    A sheet holds as many parts as its brand and type have. They come to its task a row each, in their order, and the file that
    they are drawn in is read where it was drawn: neither a sheet's parts nor its file are ever one row.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    pins = ranked_pins(spark, sf_dir, part).groupBy("refdes").agg(F.collect_list(F.struct("pin", "net")).alias("pins"))
    kinds = part.select("p_type").distinct().select("p_type", (F.row_number().over(Window.orderBy("p_type")) - 1).alias("sheet_ord"))  # a few part types
    size = F.col("p_size").cast("string")
    about = part.select("p_brand", "p_type", F.col("p_partkey").cast("long").alias("key"), refdes_of(F.col("p_type"), F.col("p_partkey")).alias("refdes"), F.when(F.col("p_size") % 10 != 0, F.concat("p_brand", F.lit("-"), size)).alias("mpn"), F.col("p_name").alias("name"), size.alias("size"))
    about = about.join(pins, "refdes", "left").join(F.broadcast(kinds), "p_type")
    sheet = F.concat("p_brand", F.lit("/"), "p_type", F.lit(".SchDoc")).alias("sheet")
    order = ["p_brand", "p_type", "key", "refdes", "mpn", "name", "size", "pins"]
    rows = about.select(sheet, "sheet_ord", *order).repartition("p_brand", "p_type").sortWithinPartitions(*order)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for b in batches for k in range(0, b.num_rows, PARTS) for p in b.slice(k, PARTS).to_pylist())
        for (brand, kind, sheet, ord_), own in groupby(parts, lambda p: (p["p_brand"], p["p_type"], p["sheet"], p["sheet_ord"])):
            yield from altium.read_records(brand, sheet, ord_, writer.sheet(drawn_records(kind, own)))

    return rows.mapInArrow(draw, altium.RECORDS)


#: Keys whose parts of a brand share a varied sheet: sheets grow in number and not in size.
SHEET_KEYS = 1000


def varied_part(at: int, place: int, key: int, size: int, name: str, kind: str, brand: str) -> list[dict]:
    """Records of a U part and an R part that stand at record ``at`` and in column ``place`` of a varied sheet.

    Odd keys write their fields in upper case. The part number is a parameter or one of two fields, the comment equals the
    value, names a parameter in another case or one that is not there, or is a text. Every seventh description ends in a byte
    that is no UTF-8. Wires without a label join pins 10 and 9 of the R part with pin 1 of the U part, and its pins B2 and A10; its
    pin 77 is alone. Every eleventh part owns a chain of five records.
    """
    said = (lambda n: n.upper()) if key % 2 else (lambda n: n)
    x = place * PART_STEP
    tip = x + PIN_LENGTH

    def pin(owner: int, number: str, row: int) -> dict[str, str]:
        spot = {said("Location.X"): str(x), said("Location.Y"): str(row * PIN_STEP), said("PinLength"): str(PIN_LENGTH)}
        return {"RECORD": "2", said("OwnerIndex"): str(owner), said("Designator"): number, **spot}

    head = {"RECORD": "1", said("CurrentPartId"): "1", **({said("PartNumber"): f"PN{size}"} if key % 3 == 1 else {said("Mpn"): f"MP{size}"} if key % 3 == 2 else {})}
    text = "|".join(f"{a}={b}" for a, b in head.items()) + f"|{said('Description')}={name}"
    own = {said("OwnerIndex"): str(at)}
    told = [("Manufacturer Part Number", f"{brand}-{size}")] if key % 3 == 0 else []
    told += [("Value", str(size)), ("KIND", kind), ("Comment", (str(size), "=Kind", "=Absent", kind)[size % 4])]
    rows: list[dict] = [{"raw": text.encode() + (b"\xff" if key % 7 == 0 else b"")}, {"RECORD": "34", **own, said("Text"): f"U{key}"}]
    rows += [{"RECORD": "41", **own, said("Name"): n, said("Text"): t} for n, t in told]
    rows += [pin(at, n, row) for n, row in (("1", 3), ("B2", 5), ("A10", 6), ("77", 8))]
    if key % 11 == 0:
        rows.append({"RECORD": "44", **own})
        rows += [{"RECORD": k, said("OwnerIndex"): str(at + len(rows) - 1 + n)} for n, k in enumerate(("45", "46", "47", "48"))]
    r_at = at + len(rows)
    rows += [{"RECORD": "1", said("CurrentPartId"): "1"}, {"RECORD": "34", said("OwnerIndex"): str(r_at), said("Text"): f"R{key}"}]
    rows += [pin(r_at, "10", 1), pin(r_at, "9", 2)]
    wire = lambda a, b: {"RECORD": "27", "X1": str(tip), "Y1": str(a * PIN_STEP), "X2": str(tip), "Y2": str(b * PIN_STEP)}
    return [*rows, wire(1, 3), wire(5, 6)]


def varied_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of varied parts, a design per brand: (design_id, sheet, sheet_ord, content).

    Every fifth U part is drawn again on the next sheet, with another description and a pin that ends nowhere.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    own = F.struct(F.col("p_partkey").cast("long").alias("key"), F.col("p_size").cast("int").alias("size"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.lit(False).alias("again"))
    once = part.select("p_brand", F.expr(f"p_partkey div {SHEET_KEYS}").alias("n"), own.alias("p"))
    again = once.where("p.key % 5 = 0").select("p_brand", F.col("n") + 1, F.col("p").withField("again", F.lit(True)))
    rows = once.union(again).groupBy("p_brand", "n").agg(F.array_sort(F.collect_list("p")).alias("parts"))  # SHEET_KEYS and a fifth

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for brand, n, parts in (tuple(x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):  # a batch has thousands of sheets
                records: list[dict] = []
                for place, p in enumerate(parts):
                    at = len(records)
                    if p["again"]:
                        records += [{"RECORD": "1", "CurrentPartId": "1", "ComponentDescription": "again"}, {"RECORD": "34", "OwnerIndex": str(at), "Text": f"U{p['key']}"}]
                        records.append({"RECORD": "2", "OwnerIndex": str(at), "Designator": "5", "Location.X": str(place * PART_STEP), "Location.Y": "0", "PinLength": str(PIN_LENGTH)})
                    else:
                        records += varied_part(at, place, p["key"], p["size"], p["name"], p["kind"], brand)
                columns = [pa.array([brand]), pa.array([f"{brand}/{n}.SchDoc"]), pa.array([n], pa.int32()), pa.array([writer.sheet(records)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["design_id", "sheet", "sheet_ord", "content"])

    return rows.mapInArrow(draw, "design_id string, sheet string, sheet_ord int, content binary")


def run_starts(columns: list[pa.Array]) -> list[int]:
    """Where runs of rows begin that are alike in all columns; rows with a null may be runs of their own."""
    new = np.arange(len(columns[0])) == 0
    for column in columns:
        codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def exported(lines: DataFrame) -> DataFrame:
    """Write each block of lines (design_id, kind, block, at, line) as a file of the shared folder: its range for ``sources.designs``.

    A task that runs again writes under new names; only what the returned rows name is read.
    """
    root = f"{xnet.shared_root(lines.sparkSession).rstrip('/')}/exports-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(root)
        system.create_dir(base, recursive=True)
        key, out, size, name = None, None, 0, ""

        def told() -> pa.RecordBatch:
            out.close()
            block = key[2]
            row = {"design_id": key[0], "kind": key[1], "path": name, "size": size, "block": block, "start": 0, "length": size, "base": block << 40}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            *keys, lines = batch.columns
            starts = run_starts(keys)
            for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = [c[start].as_py() for c in keys]
                if own != key:
                    if out:
                        yield told()
                    key, size, name = own, 0, f"{root}/{uuid.uuid4().hex}.dat"
                    out = system.open_output_stream(base + name.removeprefix(root))
                raw = "".join(f"{line}\n" for line in lines[start:end].to_pylist()).encode()
                out.write(raw)
                size += len(raw)
        if out:
            yield told()

    dealt = lines.repartition("design_id", "kind", "block").sortWithinPartitions("design_id", "kind", "block", "at").select("design_id", "kind", "block", "line")
    return xnet.cut(dealt.mapInArrow(write, "design_id string, kind string, path string, size long, block long, start long, length long, base long"))


def planted(spark: SparkSession, files: DataFrame) -> str:
    """Write an empty file for each row (path) below a new folder that driver and executors share; the folder."""
    root = f"{xnet.shared_root(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system.create_dir(base + path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(base + path):
                    pass
            yield batch

    if files.select("path").repartition("path").mapInArrow(write, "path string").count() == 0:
        system_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        system_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(system_path)
    return root


def cadence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of a fleet: a folder per nation with a design of its own, and one in it per supplier.

    Suppliers with a balance under zero have a data set and no design; of the others the design's set lies in a folder
    of its name if the balance is under 4000, else in ``out``, where that of balances over 8000 lacks a file.
    """
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    number = lambda c, n: F.lpad(c.cast("string"), n, "0")
    key, country = number(F.col("s_suppkey"), 9), number(F.col("s_nationkey"), 2)
    nation = F.concat(F.lit("/fleet/n"), country)
    folder = F.concat(nation, F.lit("/s"), key)
    board, balance = F.concat(F.lit("board"), key), F.col("s_acctbal")
    home = F.concat(folder, F.lit("/"), F.when(balance.between(0, 3999.99), F.upper(board)).otherwise("out"))
    files = [F.concat(home, F.lit(f)) for f in ("/pstxnet.dat", "/PSTXPRT.DAT")]
    files += [F.when(balance <= 8000, F.concat(home, F.lit("/pstchip.dat"))), F.when(balance >= 0, F.concat(folder, F.lit("/"), board, F.lit(".DSN")))]
    files += [F.concat(nation, F.lit("/n"), country, F.lit(".cpm"))]
    return as_listing(supplier.select(F.explode(F.array(*files)).alias("path")).where("path IS NOT NULL").distinct())


def altium_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(listing, contents) of a project per supplier.

    Projects of suppliers with a balance from 4000 name two sheets, the second of which lies elsewhere and is no sheet
    for balances from 8000; others name none, and have one sheet in a folder below or, under zero, two.
    """
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key, balance = F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.col("s_acctbal")
    folder = F.concat(F.lit("/pcb/s"), key)
    project = F.concat(folder, F.lit("/p"), key, F.lit(".PrjPcb"))
    named = F.concat(F.lit('[Design]\r\nDocumentPath=sub\\top.SchDoc|x\r\nDocumentPath="..\\shared\\b'), key, F.lit('.SchDoc"\r\nDocumentPath=notes.txt\r\n'))
    magic, other = F.lit(OLE_MAGIC + b" and more"), F.lit(b"no sheet at all")
    entry = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    files = [entry(project, F.encode(F.when(balance >= 4000, named).otherwise("[Design]\r\n"), "UTF-8")), entry(F.concat(folder, F.lit("/sub/top.SchDoc")), magic)]
    files += [F.when(balance >= 4000, entry(F.concat(F.lit("/pcb/shared/b"), key, F.lit(".SchDoc")), F.when(balance < 8000, magic).otherwise(other)))]
    files += [F.when(balance < 0, entry(F.concat(folder, F.lit("/sub/two.schdoc")), magic))]
    rows = supplier.select(F.explode(F.array(*files)).alias("f")).where("f IS NOT NULL").select("f.path", "f.content")
    return as_listing(rows.select("path")), rows
