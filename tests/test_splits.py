"""Text exports in splits against the sequential readers, cut at every byte; places and carried states over many tasks."""

import io
import random

import pytest
from pyspark.sql import functions as F
from test_cadence import CHIPS, NETS, PARTS

from copperline.operators.ordering import carried, numbered
from copperline.operators.xnet import cut
from copperline.sources import cadence, splits

MORE_NETS = "'BEFORE'\nNODE_NAME U0 1\n" + NETS + "NET_NAME\n'CLK'\nNODE_NAME  U9 1 x\nNODE_NAME 10 2\nNODE_NAME 9 1\nNODE_NAME U9 1\nNODE_NAME\nNET_NAME\nnothing\nNET_NAME\n'7'\n'8'\nNODE_NAMES R1 3\nNET_NAME\n'\nNET_NAME\n'é '\n\ufeffNODE_NAME Ü1\t2 \r"
MORE_PARTS = " A1 'FIRST':;\nMFGR_PN=x\n" + PARTS + "PART_NAME\nno head\n U1 'CHIP_B':;\nDESCR=''\nMFGR_PN='a'\nMFGR_PN=\"b=c\",\nPART_NAME\n U1 :\nMFGR_PN=z;;\nPART_NAME\n U2  'X Y' more:\n12 'N':\nPART_NAME\nMFGR_PN=early\n 12 'N':;\r\n = \nPART_NAME\n = :;\nMFGR_PN=q\nPART_NAME"
MORE_CHIPS = "pin\n'X':\nPIN_NUMBER='(9)';\n" + CHIPS + """primitive 'CHIP_A';
'EARLY':
PIN_NUMBER='(1)';
body
VALUE='first'
end_pin;
VALUE="second";
pin
PIN_NUMBER='(1)';
'A':'B':
PIN_NUMBER=(2);
'no name: here
PIN_NUMBER=(3);
'C':
PIN_NUMBER='(3)'=4;
'A':
PIN_NUMBER=(5);
end_pin;
'D':
PIN_NUMBER=(6);
pin
PIN_NUMBER=(7);
primitive RES;
body
VALUE=none
primitive 'CHIP_C' 'more';
body
VALUE=
primitive 'RES';
body
x=y
"""


def lines_of(text, split):
    data = text.encode()
    out = []
    for start in range(0, len(data), split):
        out += [(start // split, at, line) for at, line in splits.split_lines(io.BytesIO(data), len(data), start, split)]
    return out


@pytest.mark.parametrize("text", ["", "\n", "a", "a\n", "\n\na\n\nbb", "abc\ndef\n\n", NETS])
def test_lines_cut_at_every_byte(text, monkeypatch):
    places, whole = 0, []
    for line in text.encode().split(b"\n"):
        if places < len(text.encode()):
            whole.append((places, line))
        places += len(line) + 1
    for read in (1, 2, 5, 1 << 20):
        monkeypatch.setattr(splits, "READ", read)
        for split in range(1, len(text) + 2):
            got = lines_of(text, split)
            assert [(at, line) for _, at, line in got] == whole and all(at // split == block for block, at, _ in got)


def as_lines(spark, texts, split):
    rows = []
    for kind, text in texts.items():
        for design in ("a", "b"):
            rows += [(design, kind, block, at, line.decode("utf-8", "replace").strip(cadence._SPACE)) for block, at, line in lines_of(text if design == "a" else text[::2], split)]
    return spark.createDataFrame(rows, splits.LINES).repartition(3)


@pytest.mark.parametrize("split", [1, 13, 1 << 20])
def test_rows_are_those_of_the_sequential_readers(spark, split):
    texts = {"pstxnet": MORE_NETS, "pstxprt": MORE_PARTS, "pstchip": MORE_CHIPS}
    lines = as_lines(spark, texts, split).cache()
    for kind, read, columns, plain in (
        ("pstxnet", splits.nets, ["net", "net_ord", "refdes", "ref_ord", "pin", "pin_ord"], cadence.net_rows),
        ("pstxprt", splits.parts, ["refdes", "comp_ord", "part_name", "mpn", "description"], cadence.part_rows),
    ):
        got = sorted(repr(tuple(r)) for r in read(lines).select("design_id", *columns).collect())
        wanted = sorted(repr((d, *row)) for d, text in (("a", texts[kind]), ("b", texts[kind][::2])) for row in plain(text))
        assert got == wanted
    files = spark.createDataFrame([("a", "pstchip", MORE_CHIPS.encode()), ("b", "pstchip", MORE_CHIPS[::2].encode())], "design_id string, kind string, content binary")
    whole = cadence.stage_chips(files).cache()
    values, names = splits.chips(lines)
    by_part = {}
    for r in whole.orderBy("chip_ord").collect():
        by_part[r.design_id, r.part_name] = r.pins
    wanted = {(d, p, number): name for (d, p), pins in by_part.items() for name, number in pins.items() if number}
    assert {(r.design_id, r.part_name, r.pin): r.pin_name for r in names.collect()} == wanted
    valued = {(r.design_id, r.part_name): r.body["VALUE"] for r in whole.orderBy("chip_ord").collect() if r.body.get("VALUE")}
    assert {(r.design_id, r.part_name): r.chip_value for r in values.collect()} == valued


def test_files_in_splits(spark, tmp_path):
    for name, text in (("n.dat", MORE_NETS), ("p.dat", MORE_PARTS), ("c.dat", MORE_CHIPS), ("none.dat", "")):
        (tmp_path / name).write_bytes(text.encode())
    kinds = [("pstxnet", "n.dat"), ("pstxprt", "p.dat"), ("pstchip", "c.dat"), ("pstxnet", "none.dat"), ("pstxnet", "missing.dat")]
    wanted = spark.createDataFrame([("a", k, f"{tmp_path}/{f}") for k, f in kinds[:3]] + [("b", k, f"file://{tmp_path}/{f}") for k, f in kinds[3:]], "design_id string, kind string, path string")
    assert splits.read_lines(wanted, 29).select("block").distinct().count() > 16
    content = spark.createDataFrame([("a", k, t.encode()) for k, t in (("pstxnet", MORE_NETS), ("pstxprt", MORE_PARTS), ("pstchip", MORE_CHIPS))], "design_id string, kind string, content binary")
    for table in ("components", "component_pins", "net_pins", "nets"):
        one, two = (getattr(n, table).collect() for n in (cadence.split_netlist(wanted, 37), cadence.netlist(content)))
        assert sorted(map(repr, one)) == sorted(map(repr, two)) and one


def test_numbers_within_a_key_of_many_tasks(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randrange(10**6), i) for i in range(3000)]
    got = numbered(spark.createDataFrame(rows, "k string, x long, i long"), ["k"], ["x", "i"], "place", cut).collect()
    wanted = {}
    for k, x, i in sorted(rows):
        wanted.setdefault(k, []).append((x, i))
    assert len(got) == len(rows) and all(wanted[r.k][r.place] == (r.x, r.i) for r in got)


def test_states_are_carried_over_blocks(spark):
    rng = random.Random(4)
    rows = [(f"d{d}", at // 7, at, rng.choice([None, None, None, at]), rng.choice([None, "s"])) for d in range(3) for at in range(100)]
    df = spark.createDataFrame(rows, "d string, block long, at long, v long, s string").repartition(5)
    got = {(r.d, r.at): (r.a, r.b) for r in carried(df, ["d"], "block", "at", {"a": F.col("v"), "b": F.col("s")}).collect()}
    for d in range(3):
        a = b = None
        for key, _, at, v, s in rows:
            if key == f"d{d}":
                a, b = v if v is not None else a, s if s is not None else b
                assert got[key, at] == (a, b)
