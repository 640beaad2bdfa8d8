from copperline import api
from copperline.sources import cadence, formats, listing

NETS = """FILE_TYPE=x
NET_NAME
'CLK'
 '@LIB.X(SCH_1):CLK':
NODE_NAME\tU1 3
 '@LIB':
NODE_NAME R1 1
NODE_NAME U1 4
NODE_NAME @LIB.SHEET(SCH_1):INS1@PART 9
NET_NAME
'EMPTY'
NET_NAME
'GND'
NODE_NAME R1 2
NODE_NAME J7 A1
NODE_NAME U1 3
"""
PARTS = """FILE_TYPE
PART_NAME
 U1 'CHIP_A':;
 MFGR_PN='STM=32';
 DESCR="an mcu, small",
PART_NAME
 R1 'RES':;
PART_NAME
 X1 :
"""
CHIPS = """primitive 'CHIP_A';
pin
'CLK_IN':
 PIN_NUMBER='(3)';
'4':
 PIN_NUMBER='(4)';
end_pin;
body
 VALUE='';
end_body;
end_primitive;
primitive 'RES';
pin
 'A':
 PIN_NUMBER='(1,0)';
end_pin;
body
 VALUE='4.7K';
"""


def files(spark, designs):
    rows = [(d, k, t.encode()) for d, own in designs.items() for k, t in zip(("pstxnet", "pstxprt", "pstchip"), own, strict=True)]
    return spark.createDataFrame(rows, "design_id string, kind string, content binary")


def test_line_parsers():
    rows = cadence.net_rows(NETS)
    assert [r[0] for r in rows] == ["CLK"] * 4 + ["EMPTY"] + ["GND"] * 3
    assert rows[0][2:] == ("U1", 0, "3", 0) and rows[1][2:] == ("U1", 0, "4", 1) and rows[4][2] is None
    assert cadence.net_rows("") == [] and cadence.net_rows("NET_NAME\n'A'\nNODE_NAME U1\nNET_NAME\n'A'\nNODE_NAME U2 1") == [("A", 0, "U2", 0, "1", 0)]
    assert cadence.part_rows(PARTS) == [("U1", 0, "CHIP_A", "STM=32", "an mcu, small"), ("R1", 1, "RES", "RES", None), ("X1", 2, None, None, None)]
    assert cadence.chip_rows(CHIPS) == [("CHIP_A", 0, {"CLK_IN": "3", "4": "4"}, {"VALUE": ""}), ("RES", 1, {"A": "1,0"}, {"VALUE": "4.7K"})]


def test_keys_come_in_object_order():
    assert cadence.key_order(["B", "10", "9", "A", "01"]) == ["9", "10", "B", "A", "01"]


def test_netlist_of_two_designs(spark):
    net = cadence.netlist(files(spark, {"a": (NETS, PARTS, CHIPS), "b": ("NET_NAME\n'N'\nNODE_NAME C1 1", "", "")}))
    comps = {(r.design_id, r.refdes): r for r in net.components.collect()}
    assert set(comps) == {("a", "U1"), ("a", "R1"), ("a", "X1"), ("a", "J7"), ("b", "C1")}
    assert comps["a", "U1"].mpn == "STM=32" and comps["a", "R1"].value == "4.7K" and comps["a", "U1"].value is None
    assert comps["a", "X1"].mpn_present and not comps["a", "J7"].mpn_present
    assert [r.refdes for r in net.components.where("design_id = 'a'").orderBy("comp_ord").collect()] == ["U1", "R1", "X1", "J7"]
    pins = {(r.refdes, r.pin): (r.pin_name, r.net) for r in net.component_pins.where("design_id = 'a'").collect()}
    assert pins == {("U1", "3"): ("CLK_IN", "GND"), ("U1", "4"): (None, "CLK"), ("R1", "1"): (None, "CLK"), ("R1", "2"): (None, "GND"), ("J7", "A1"): (None, "GND")}
    assert net.net_pins.where("refdes LIKE '@%'").count() == 1
    assert {r.net for r in net.nets.where("design_id = 'a'").collect()} == {"CLK", "EMPTY", "GND"}


def place(root, path, texts=(NETS, PARTS, CHIPS), names=("pstxnet.dat", "PSTXPRT.DAT", "pstchip.dat")):
    folder = root / path
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in zip(names, texts, strict=True):
        (folder / name).write_text(text)


def found(spark, root):
    rows = listing.cadence_designs(listing.listing(spark, str(root))).collect()
    return {r.name: (r.pstxnet or "").removeprefix(f"{root}/") or r.error for r in rows}


def test_discovery(spark, tmp_path):
    for name in ("board.dsn", "board_v2.DSN", "other/hdl.cpm", "other/none.dsn"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).touch()
    place(tmp_path, "out/board")
    place(tmp_path, "out/deep/board_v2/x")
    place(tmp_path, "other/alone")
    (tmp_path / "orphan").mkdir()
    (tmp_path / "orphan" / "pstxnet.dat").write_text("")
    assert found(spark, tmp_path) == {"board": "out/board/pstxnet.dat", "board_v2": "out/deep/board_v2/x/pstxnet.dat", "hdl": "other/alone/pstxnet.dat", "none": listing.NOT_EXPORTED}


def test_loading_a_design(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    design = tmp_path / "a b" / "Main.DSN"
    design.touch()
    (tmp_path / "a b" / "second.dsn").touch()
    assert api.list_nets(spark, str(design)) == {"error": "Missing netlist files for Main.DSN. Run export_cadence_netlist to generate them."}
    place(tmp_path, "a b/allegro")
    assert api.list_nets(spark, str(design).replace("/", "\\")) == {"nets": ["CLK", "EMPTY", "GND"]}
    assert api.list_nets(spark, str(tmp_path / "a b" / "second.dsn"))["nets"] == ["CLK", "EMPTY", "GND"]
    assert api.query_component(spark, str(design), "u1")["pins"]["3"] == {"name": "CLK_IN", "net": "GND"}
    assert api.list_nets(spark, "/x/y.txt") == {"error": "Unsupported design file format '.txt'. Supported: .dsn, .cpm (Cadence), .PrjPcb (Altium)"}
    listed = api.list_designs(spark, str(tmp_path), "^M")
    assert listed == [{"name": "Main", "path": str(design)}]
    assert api.list_designs(spark, str(tmp_path), "[") == {"error": "Invalid regex pattern '['"}
    assert formats.supported_extensions() == [".dsn", ".cpm", ".prjpcb"] and formats.find_format("a.CPM").name == "cadence" and formats.find_format("x") is None


def test_paths():
    assert listing.normal_path("\\a\\.\\b\\..\\c") == "/a/c" and listing.normal_path("a//b/") == "a/b/"


def test_stream_of_new_exports(spark, tmp_path):
    from copperline.streaming import watch

    place(tmp_path, "in/one")
    query = watch.net_pin_stream(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("net_pins_seen").outputMode("append").start()
    try:
        query.processAllAvailable()
        first = spark.table("net_pins_seen").count()
        place(tmp_path, "in/two")
        query.processAllAvailable()
        assert first == 8 and spark.table("net_pins_seen").count() == 16
    finally:
        query.stop()
