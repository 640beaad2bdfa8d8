import pytest
from cfb import container, sheet, stream

from copperline import api
from copperline.operators import geometry
from copperline.operators.xnet import cut
from copperline.sources import altium, listing
from copperline.sources.ole import CompoundFile, OleError, read_stream


def part(refdes, pins, at, mpn=None, more=(), **fields):
    """Records of a component at list position ``at``: pins are (number, name, x, y, turn)."""
    rows = [{"RECORD": "1", **fields}, {"RECORD": "34", "OwnerIndex": str(at), "Text": refdes}]
    for number, name, x, y, turn in pins:
        rows.append({"RECORD": "2", "OwnerIndex": str(at), "Designator": number, "Name": name, "Location.X": str(x), "Location.Y": str(y), "PinLength": "10", "PinConglomerate": str(turn)})
    if mpn:
        rows.append({"RECORD": "41", "OwnerIndex": str(at), "Name": "Manufacturer Part Number", "Text": mpn})
    return rows + [{"RECORD": "41", "OwnerIndex": str(at), **m} for m in more]


def wire(*points):
    return {"RECORD": "27"} | {f"{a}{k}": str(v) for k, p in enumerate(points, 1) for a, v in zip("XY", p, strict=True)}


def label(text, x, y, kind="25"):
    return {"RECORD": kind, "Text": text, "Location.X": str(x), "Location.Y": str(y)}


def sheets(spark, designs):
    rows = [(d, f"{d}/{k}", k, sheet(r)) for d, own in designs.items() for k, r in enumerate(own)]
    return spark.createDataFrame(rows, "design_id string, sheet string, sheet_ord int, content binary")


def nets_of(net, design="d"):
    out = {}
    for r in net.net_pins.where(f"design_id = '{design}'").orderBy("net_ord", "ref_ord", "pin_ord").collect():
        out.setdefault(r.net, {}).setdefault(r.refdes, []).append(r.pin)
    return out


def test_container_streams():
    big = bytes(range(256)) * 40
    for shift in (9, 12):
        data = container({"Small": b"abc", "FileHeader": big, "Empty": b""}, shift=shift)
        file = CompoundFile(data)
        assert file.streams() == ["Small", "FileHeader", "Empty"]
        assert file.read("fileheader") == big and file.read("SMALL") == b"abc" and file.read("Empty") == b""
    with pytest.raises(OleError, match="magic"):
        CompoundFile(b"x" * 600)
    with pytest.raises(OleError, match="not found"):
        read_stream(container({"A": b"x"}))


def test_records_split_and_keep_values():
    rows = altium.record_fields(stream([{"HEADER": "h"}, {"RECORD": "1", "A": " x=y ", "": "z"}, {" Key ": "1", "RECORD": "2"}, {"raw": b"RECORD=41|Text=\xff"}]))
    assert rows == [{"HEADER": "h"}, {"RECORD": "1", "A": " x=y "}, {"Key": "1", "RECORD": "2"}, {"RECORD": "41", "Text": "�"}]
    owned = altium.record_rows(stream([{"RECORD": "1"}, {"RECORD": "2", "OWNERINDEX": "0"}, {"RECORD": "2", "OwnerIndex": "9"}, {"RECORD": "2", "OwnerIndex": "0x"}]))
    assert [r[2] for r in owned] == [None, 0, None, 0]


def test_a_sheet_becomes_a_netlist(spark):
    records = [
        *part("R1", [("1", "A", 0, 0, 2), ("2", "2", 20, 0, 0)], 0, mpn="RES-1", more=[{"Name": "Comment", "Text": "=Value"}, {"Name": "Value", "Text": " 10k "}], ComponentDescription="resistor"),
        *part("U1", [("1", "VIN", 100, 0, 2), ("2", "", 100, 50, 1), ("3", "x", 300, 300, 0)], 7, PartNumber="CHIP"),
        wire((30, 0), (90, 0)),
        label("VBUS", -10, 0, "17"),
        label("VBUS", 100, 60),
    ]
    net = altium.netlist(sheets(spark, {"d": [records]}))
    assert nets_of(net) == {"VBUS": {"R1": ["1"], "U1": ["2"]}, "NetR1_2": {"R1": ["2"], "U1": ["1"]}}
    comps = {r.refdes: r for r in net.components.collect()}
    assert (comps["R1"].mpn, comps["R1"].description, comps["R1"].comment, comps["R1"].value) == ("RES-1", "resistor", None, "10k")
    assert comps["U1"].mpn == "CHIP" and comps["U1"].mpn_present
    pins = {(r.refdes, r.pin): (r.pin_name, r.net) for r in net.component_pins.collect()}
    assert pins == {("R1", "1"): ("A", "VBUS"), ("R1", "2"): (None, "NetR1_2"), ("U1", "1"): ("VIN", "NetR1_2"), ("U1", "2"): (None, "VBUS"), ("U1", "3"): ("x", "")}


@pytest.mark.parametrize(("turn", "x", "y"), [(0, 10, 0), (1, 0, 10), (2, -10, 0), (3, 0, -10), (7, 0, -10)])
def test_pin_ends(spark, turn, x, y):
    net = altium.netlist(sheets(spark, {"d": [[*part("U1", [("1", "", 0, 0, turn)], 0), label("L", x, y)]]}))
    assert nets_of(net) == {"L": {"U1": ["1"]}}


def test_fractions_and_casings(spark):
    pin = {"RECORD": "2", "OWNERINDEX": "0", "DESIGNATOR": "5", "LOCATION.X": "1", "LOCATION.X_FRAC": "5000", "LOCATION.Y": "0", "PINLENGTH": "0"}
    records = [{"RECORD": "1"}, {"RECORD": "34", "OWNERINDEX": "0", "TEXT": "J1"}, pin, {"RECORD": "25", "TEXT": "N", "LOCATION.X": "1", "LOCATION.X_FRAC": "5000"}, {"RECORD": "25", "TEXT": "M", "LOCATION.X": "1"}]
    assert nets_of(altium.netlist(sheets(spark, {"d": [records]}))) == {"N": {"J1": ["5"]}}


def test_pins_of_other_parts_are_left_out(spark):
    pins = [{"RECORD": "2", "OwnerIndex": "0", "Designator": n, "OwnerPartId": p, "Location.X": "0", "Location.Y": "0"} for n, p in (("1", "1"), ("2", "2"), ("3", ""))]
    records = [{"RECORD": "1", "CurrentPartId": "1"}, {"RECORD": "34", "OwnerIndex": "0", "Text": "U1"}, *pins, label("N", 0, 0)]
    net = altium.netlist(sheets(spark, {"d": [records]}))
    assert nets_of(net) == {"N": {"U1": ["1", "3"]}} and {r.pin for r in net.component_pins.collect()} == {"1", "3"}


def test_sheets_merge_and_lone_pins_go(spark):
    one = [*part("R1", [("1", "", 0, 0, 0)], 0, mpn="A"), label("N", 10, 0), *part("R9", [("1", "", 500, 500, 0)], 5)]
    two = [*part("R1", [("1", "", 0, 0, 0), ("2", "", 0, 50, 0)], 0, mpn="B"), label("N", 10, 0), label("N", 10, 50)]
    net = altium.netlist(sheets(spark, {"d": [one, two], "e": [[]]}))
    assert nets_of(net) == {"N": {"R1": ["1", "2"]}}
    assert {r.refdes: r.mpn for r in net.components.collect()} == {"R1": "A", "R9": None}
    assert {(r.refdes, r.pin): r.net for r in net.component_pins.collect()} == {("R1", "1"): "N", ("R9", "1"): ""}


def test_derived_names_take_the_least_pin(spark):
    records = [*part("U2", [("10", "", 0, 0, 0)], 0), *part("U10", [("B", "", 30, 0, 2), ("9", "", 20, 10, 3)], 3), wire((10, 0), (20, 0))]
    assert set(nets_of(altium.netlist(sheets(spark, {"d": [records]})))) == {"NetU10_9"}


def test_record_views(spark):
    records = [*part("R1", [("1", "", 0, 0, 0)], 0), {"RECORD": "1", "OwnerIndex": "0"}]
    rows = cut(altium.records(sheets(spark, {"d": [records]})))
    assert altium.record_view(rows, "all-list").count() == 4 and altium.record_view(rows, "parts-list").count() == 1
    assert altium.record_view(rows).where("is_root").count() == 1
    assert altium.record_view(rows, "net-list").count() == 1
    assert [r.path for r in altium.flattened(rows).orderBy("path").collect()] == [[0], [0, 1], [0, 2], [0, 3]]
    assert altium.find_records(rows, "Text", "R1").count() == 1
    assert rows.where(altium.valid_records(rows, altium.DESIGNATOR)).count() == 1


def test_touching_is_by_bounding_box(spark):
    data = [("s", 1, [(0, 0), (100, 100)]), ("s", 2, [(50, 60)]), ("s", 3, [(25000, 0), (-5, 0)]), ("s", 4, [(101, 50)]), ("t", 5, [(50, 60)]), ("s", 6, [])]
    df = spark.createDataFrame([(a, b, [{"x": x, "y": y} for x, y in p]) for a, b, p in data], "sheet string, idx int, points array<struct<x:long,y:long>>")
    assert {(r.a, r.b) for r in geometry.touching(df, ["sheet"]).collect()} == {(1, 2), (1, 3)}


def test_chains_form_one_group(spark):
    rows = [("s", k, [{"x": k * 7000, "y": 0}, {"x": (k + 1) * 7000, "y": 0}], None) for k in range(40)] + [("s", 100, [{"x": -1, "y": 9}], "P"), ("s", 101, [{"x": 7000, "y": 0}], "P")]
    df = spark.createDataFrame(rows, "sheet string, idx int, points array<struct<x:long,y:long>>, label string")
    assert {r.group for r in geometry.connected_groups(df, ["sheet"], cut).collect()} == {0}


def test_projects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.SchDoc").write_bytes(sheet([*part("R1", [("1", "", 0, 0, 0)], 0), label("N", 10, 0)]))
    (tmp_path / "sub" / "b.SchDoc").write_bytes(sheet([*part("R2", [("1", "", 0, 0, 0)], 0), label("N", 10, 0)]))
    (tmp_path / "text.SchDoc").write_text("no container")
    listed = 'x\nDocumentPath="a.SchDoc"\n documentpath=sub\\b.SchDoc|more\nDocumentPath=C:\\z.SchDoc\nDocumentPath=/z.SchDoc\nDocumentPath=text.SchDoc\nDocumentPath=a.PcbDoc\n'
    (tmp_path / "main.PrjPcb").write_text(listed)
    (tmp_path / "sub" / "only.prjpcb").write_text("")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.PrjPcb").write_text("")
    assert listing.document_paths("/p/m.PrjPcb", listed.encode()) == ["/p/a.SchDoc", "/p/sub/b.SchDoc", "/p/text.SchDoc"]
    rows = {r.name: r for r in listing.altium_designs(listing.listing(spark, str(tmp_path))).collect()}
    assert [s.removeprefix(f"{tmp_path}/") for s in rows["main"].sheets] == ["a.SchDoc", "sub/b.SchDoc"]
    assert [s.removeprefix(f"{tmp_path}/") for s in rows["only"].sheets] == ["sub/b.SchDoc"]
    assert rows["empty"].error == "No schematic documents found for project 'empty'."
    answer = api.query_xnet_by_net_name(spark, str(tmp_path / "main.PrjPcb"), "N")
    assert answer["total_components"] == 2
    assert api.list_nets(spark, str(tmp_path / "none" / "empty.PrjPcb"))["error"] == f"No schematic documents found for project {tmp_path}/none/empty.PrjPcb"
    assert [d["name"] for d in api.list_designs(spark, str(tmp_path))] == ["empty", "main", "only"]


def test_flattening_has_no_depth_limit(spark):
    ddl = "design_id string, sheet string, idx int, owner int"
    rows = spark.createDataFrame([("d", "s", k, k - 1 if k else None) for k in range(30)] + [("d", "s", 40, 3)], ddl)
    got = {r.idx: r.path for r in altium.flattened(rows).collect()}
    assert got == {k: list(range(k + 1)) for k in range(30)} | {40: [0, 1, 2, 3, 40]}
    with pytest.raises(ValueError, match="cycle"):
        altium.flattened(spark.createDataFrame([("d", "s", 1, 3), ("d", "s", 2, 1), ("d", "s", 3, 2), ("d", "s", 4, 1)], ddl))
