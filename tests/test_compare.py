"""Comparing netlists, a saved one among them; and walking real trees in tasks."""

import os

from copperline.operators import compare
from copperline.plans.netlist import Netlist, from_rows
from copperline.sources import listing

BOARD = {"components": {"R1": {"mpn": "A", "value": "1k", "pins": {"1": "N1", "2": ("K", "GND")}}, "C1": {"pins": {"1": "N1", "2": "GND"}}}, "nets": {"N1": {"R1": ["1"], "C1": ["1", "1"]}, "GND": {"R1": ["2"], "C1": ["2"]}}}


def told(was, now, **how):
    return {(r.of_table, r.design_id, r.part_or_net, r.name, r.change) for r in compare.differences(was, now, **how).collect()}


def test_a_saved_netlist_equals_itself(spark, tmp_path):
    net = from_rows(spark, {"a": BOARD, "b": BOARD})
    net.write(f"file://{tmp_path}/saved")
    assert told(Netlist.read(spark, f"file://{tmp_path}/saved"), net, orders=True) == set()


def test_rows_that_differ(spark):
    later = {"components": {"R1": {"mpn": None, "value": "1k", "pins": {"1": "N1", "2": ("J", "GND")}}, "U9": {"pins": {}}}, "nets": {"N1": {"R1": ["1"], "C1": ["1"]}, "GND": {"C1": ["2"], "R1": ["2"]}, "N2": {}}}
    was, now = from_rows(spark, {"a": BOARD, "b": BOARD}), from_rows(spark, {"a": BOARD, "b": later, "c": {"components": {}, "nets": {"X": {}}}})
    lost = {("components", "b", "C1", "C1", "lost"), ("component_pins", "b", "C1", "C1.1", "lost"), ("component_pins", "b", "C1", "C1.2", "lost"), ("net_pins", "b", "N1", "N1.C1.1#2", "lost")}
    other = {("components", "b", "R1", "R1", "changed"), ("component_pins", "b", "R1", "R1.2", "changed"), ("components", "b", "U9", "U9", "added"), ("nets", "b", "N2", "N2", "added"), ("nets", "c", "X", "X", "added")}
    assert told(was, now) == lost | other
    assert {(t, d, n) for t, d, _, n, _ in told(was, now, orders=True)} > {(t, d, n) for t, d, _, n, _ in lost | other}
    row = compare.differences(was, now).where("name = 'R1.2'").first()
    assert row.was == '{"pin_name":"K","net":"GND"}' and row.now == '{"pin_name":"J","net":"GND"}'


def test_nothing_in_one_of_them(spark):
    none = from_rows(spark, {})
    assert told(none, none) == set()
    assert {c for *_, c in told(none, from_rows(spark, {"a": BOARD}))} == {"added"} and {c for *_, c in told(from_rows(spark, {"a": BOARD}), none)} == {"lost"}


def test_walk_of_a_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PAGE", 3)
    names = ["top.DSN", "a b/.hidden", "a b/x.tar.GZ", "a b/none", "a b/dot.", "ü/deep/er/still/f.txt", "_under/_f.dat", *(f"many/{i}.x" for i in range(20))]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "many", tmp_path / "again")
    os.symlink(tmp_path / "top.DSN", tmp_path / "link.dsn")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.dsn")
    rows = {r.path: r for r in listing.listing(spark, f"{tmp_path}/", f"{tmp_path}/many", f"file://{tmp_path}/ü").collect()}
    assert set(rows) == {f"{tmp_path}/{n}" for n in [*names, "link.dsn"]}
    assert {(r.name, r.stem, r.ext) for p, r in rows.items() if "/a b/" in p} == {(".hidden", ".hidden", ""), ("x.tar.GZ", "x.tar", ".gz"), ("none", "none", ""), ("dot.", "dot", ".")}
    assert rows[f"{tmp_path}/top.DSN"].dir == str(tmp_path)
    assert listing.listing(spark, f"{tmp_path}/empty").collect() == []
