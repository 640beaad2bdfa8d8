"""The indexed source of designs: the same rows as the other readers, and only the files of the designs that are asked for."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull
from test_splits import MORE_CHIPS, MORE_NETS, MORE_PARTS

from copperline.sources import altium, cadence, designs, splits, writer

SHEET = [{"RECORD": "1", "CurrentPartId": "1"}, {"RECORD": "34", "OwnerIndex": "0", "Text": "U1"}, {"RECORD": "2", "OwnerIndex": "0", "Designator": "1"}]


@pytest.fixture
def fleet(spark, tmp_path):
    """(index, files by design) of three text exports and two projects of sheets."""
    rows, sheets = [], []
    for d in "abc":
        for kind, text in (("pstxnet", MORE_NETS), ("pstxprt", MORE_PARTS), ("pstchip", MORE_CHIPS)):
            path = tmp_path / d / f"{kind}.dat"
            path.parent.mkdir(exist_ok=True)
            path.write_bytes(text.replace("CLK", f"CLK_{d}").encode())
            rows.append((d, kind, str(path)))
    for k, d in enumerate("xyy"):
        path = tmp_path / f"{k}.SchDoc"
        path.write_bytes(writer.sheet(SHEET))
        sheets.append((d, str(path), k))
    exports = designs.export_ranges(spark.createDataFrame([*rows, ("a", "pstxnet", "/no/such/file")], "design_id string, kind string, path string"), 31)
    drawn = designs.sheet_ranges(spark.createDataFrame(sheets, "design_id string, sheet string, sheet_ord int"))
    index = designs.index(exports.unionByName(drawn), str(tmp_path / "index"), buckets=7)
    return index, rows, sheets


def tables(net):
    return [sorted(map(repr, getattr(net, t).collect())) for t in ("components", "component_pins", "net_pins", "nets")]


def test_all_designs_are_those_of_the_other_readers(spark, fleet):
    index, rows, sheets = fleet
    wanted = spark.createDataFrame(rows, "design_id string, kind string, path string")
    assert tables(cadence.netlist_of_lines(designs.export_lines(spark, index))) == tables(cadence.split_netlist(wanted, 31))
    files = altium.file_records(spark.createDataFrame(sheets, "design_id string, sheet string, sheet_ord int"))
    read = designs.sheet_records(spark, index)
    assert sorted(map(repr, read.select(files.columns).collect())) == sorted(map(repr, files.collect())) and read.count() == 9


def test_a_question_to_one_design_opens_its_files_only(spark, fleet):
    index, rows, _ = fleet
    read = designs.export_lines(spark, index)
    whole = {d: sorted(map(repr, read.where("line <> ''").collect())) for d in "b"}
    for d, _, path in rows:
        if d != "b":
            os.remove(path)  # whoever opens it fails
    with pytest.raises(Exception, match="No such file|FileNotFound|Failed to open"):
        read.count()
    for asked in (F.col("design_id") == "b", F.col("design_id").isin("b", "none"), (F.col("design_id") == "b") & (F.col("kind") == "pstxnet")):
        found = read.where(asked)
        assert found.count() and {r.design_id for r in found.select("design_id").distinct().collect()} == {"b"}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "design_id" not in "".join(x for x in plan.splitlines() if x.lstrip(" :+-*(0123456789)").startswith("Filter"))
    assert sorted(map(repr, read.where("design_id = 'b' AND line <> ''").collect())) == [r for r in whole["b"] if "design_id='b'" in r]
    assert read.where("design_id = 'none'").count() == 0 and read.where("design_id = 'b' AND design_id = 'a'").count() == 0


def test_files_opened_are_those_of_the_asked_ids(fleet, monkeypatch):
    index, rows, sheets = fleet
    opened = []
    real = designs.opened
    monkeypatch.setattr(designs, "opened", lambda path: opened.append(path) or real(path))

    def run(filters, sheets=False):
        opened.clear()
        reader = designs._Reader(index, sheets)
        left = list(reader.pushFilters(filters))
        n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        return left, n, set(opened)

    known, other = IsNotNull(("design_id",)), EqualTo(("kind",), "pstxnet")
    _, n, files = run([])
    assert files == {p for _, _, p in rows} and n
    left, one, files = run([known, EqualTo(("design_id",), "c"), other])
    assert left == [other] and files == {p for d, _, p in rows if d == "c"} and 0 < one < n
    assert run([In(("design_id",), ["a", None, "c"]), EqualTo(("design_id",), "c")])[1:] == (one, files)
    assert run([EqualTo(("design_id",), "y")])[1:] == (0, set())
    assert run([EqualTo(("design_id",), "y")], sheets=True)[1:] == (6, {p for d, p, _ in sheets if d == "y"})
    assert list(designs._Reader(index, False).read(None)) == []


def test_ranges_of_a_large_design_are_many_partitions(fleet, spark, tmp_path):
    index, _, _ = fleet
    reader = designs._Reader(index, False)
    list(reader.pushFilters([EqualTo(("design_id",), "a")]))
    n = sum(os.path.getsize(p) // 31 + 1 for d, _, p in fleet[1] if d == "a")
    assert len(reader.partitions()) >= n // designs.RANGES
    empty = spark.createDataFrame([(None, "pstxnet", fleet[1][0][2])], "design_id string, kind string, path string")
    assert designs.export_lines(spark, designs.index(designs.export_ranges(empty), str(tmp_path / "none"))).count() == 0


def test_parts_of_an_export_keep_their_order(spark, tmp_path):
    lines = MORE_NETS.split("\n")
    rows = []
    for block in range(0, len(lines), 4):
        path = tmp_path / f"{block}.dat"
        path.write_bytes("\n".join(lines[block : block + 4]).encode())
        size = os.path.getsize(path)
        rows.append(("d", "pstxnet", str(path), size, block // 4, 0, max(size, 1), block << 40))
    ranges = spark.createDataFrame(rows, "design_id string, kind string, path string, size long, block long, start long, length long, base long")
    read = designs.export_lines(spark, designs.index(ranges, str(tmp_path / "index")))
    whole = tmp_path / "whole.dat"
    whole.write_bytes(MORE_NETS.encode())
    expected = splits.read_lines(spark.createDataFrame([("d", "pstxnet", str(whole))], "design_id string, kind string, path string"))
    assert sorted(map(repr, splits.nets(read).collect())) == sorted(map(repr, splits.nets(expected).collect()))
