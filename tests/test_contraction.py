"""Star contraction against union-find, with hubs; the grids of the spatial join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from copperline.operators import contraction, geometry, xnet
from copperline.plans.netlist import from_rows


def plain(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for key, a, b in links:
        if a is not None and b is not None and a != b:
            x, y = root((key, a)), root((key, b))
            parent[max(x, y)] = min(x, y)
    return {x: root(x)[1] for x in parent}


def labelled(spark, links, kind="long"):
    df = spark.createDataFrame(links, f"key string, a {kind}, b {kind}").repartition(4)
    rows = contraction.star_labels(df, ["key"], xnet.cut).collect()
    assert len(rows) == len({(r.key, r.node) for r in rows})
    return {(r.key, r.node): r.label for r in rows}


def test_components_of_all_shapes(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10_000), 400)
    links = [("path", i, i + 1) for i in range(200)] + [("mixed", a, b) for a, b in zip(ids, ids[1:], strict=False)]
    links += [("random", rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [("star", 5000, i) for i in range(100)]
    links += [("random", 7, 7), ("random", None, 1), ("alone", 3, 3), ("path", 0, 1), ("star", 4, 5000)]
    assert labelled(spark, links) == plain(links)


def test_nodes_of_text(spark):
    links = [("x", "b", "c"), ("x", "c", "é"), ("y", "b", "a"), ("x", "Z", "é")]
    assert labelled(spark, links, "string") == plain(links)


def test_no_links(spark):
    assert labelled(spark, []) == {}


@pytest.mark.parametrize("hub", [0, 9_999])
def test_hubs_are_in_no_task_of_their_own(spark, monkeypatch, hub):
    """One component of a third of all rows around a single node: its rows meet their least one where they are."""
    monkeypatch.setattr(contraction, "HUB_ROWS", 100)
    monkeypatch.setattr(contraction, "HUBS", 8)
    links = [("k", hub, i) for i in range(10, 2010)] + [("k", 20_000 + 3 * i, 20_001 + 3 * i) for i in range(2000)]
    assert labelled(spark, links) == plain(links)
    rows = spark.createDataFrame(links, "key string, a long, b long").repartition(8).cache()
    found = contraction.with_least(rows, ["key", "a"], "b", "m", len(links))
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()
    assert {(r.a, r.m) for r in found.collect()} == {(hub, 10)} | {(a, b) for _, a, b in links if a != hub}
    hubs = found.where(F.col("a") == hub).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(hubs) >= 8 and max(r["count"] for r in hubs) < 2 * 2000 / 8


def test_extended_nets_of_a_bus_of_passives(spark):
    """A third of all parts in one extended net, the others in nets of their own."""
    parts = {f"R{i}": {"pins": {"1": "BUS", "2": f"N{i:04}"}} for i in range(300)}
    parts |= {f"C{i}": {"pins": {"1": f"A{i}", "2": f"B{i}"}} for i in range(300)} | {f"U{i}": {"pins": {"1": f"A{i}", "2": "NX", "3": "GND"}} for i in range(300)}
    got = {r.net: r.label for r in xnet.closures(from_rows(spark, {"d": {"components": parts}})).collect()}
    wanted = {"BUS": "BUS", "NX": "NX"} | {f"N{i:04}": "BUS" for i in range(300)} | {n: f"A{i}" for i in range(300) for n in (f"A{i}", f"B{i}")}
    assert got == wanted


def devices(spark, rows):
    return spark.createDataFrame(rows, "sheet string, idx long, points array<struct<x:long,y:long>>, label string")


def plain_touching(rows):
    out = set()
    ends = lambda p: list(zip(p[:-1], p[1:], strict=True)) or [(p[0], p[0])]
    for s, i, p, _ in rows:
        for t, j, q, _ in rows:
            if s == t and i != j and p and q:
                for a, b in ends(p):
                    for x, y in [e for seg in ends(q) for e in seg]:
                        if min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1]):
                            out.add((s, min(i, j), max(i, j)))
    return out


def test_grids_of_all_levels(spark):
    rng = random.Random(2)
    rows = [("s", 0, [(-(10**9), 5), (10**9, 5)], None), ("s", 1, [(0, 0), (0, 10**7), (10**7, 10**7)], None), ("s", 2, [(5, 5)], None), ("s", 3, [], None)]
    for i in range(4, 120):
        reach = rng.choice([0, 10, 9_999, 10_000, 10_001, 80_000, 3_000_000])
        x, y = rng.randrange(-200_000, 200_000, 5_000), rng.randrange(-200_000, 200_000, 5_000)
        rows.append(("s" if i % 3 else "t", i, [(x, y), (x + rng.randint(-reach, reach), y), (x, y + reach)][: rng.randint(1, 3)], None))
    found = devices(spark, rows)
    assert {tuple(r) for r in geometry.touching(found, ["sheet"]).collect()} == plain_touching(rows)
    links = [(s, a, b) for s, a, b in plain_touching(rows)]
    groups = plain(links)
    assert {(r.sheet, r.idx): r.group for r in geometry.connected_groups(found, ["sheet"], xnet.cut).collect()} == {(s, i): groups.get((s, i), i) for s, i, _, _ in rows}


def test_a_wide_box_stays_four_rows(spark):
    rows = [("s", 0, [(0, 0), (10**12, 10**12)], None), ("s", 1, [(1, 1), (9_000, 9_000)], None)]
    seg = geometry.segments(devices(spark, rows), ["sheet"])
    boxes = geometry.boxes_by_cell(seg, ["sheet"])
    assert boxes.groupBy("box").count().where("count > 4").isEmpty()
    ends = seg.select("sheet", F.col("idx").alias("tip"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    assert geometry.ends_by_cell(ends, [0, 27]).count() == 2 * ends.count()


@pytest.mark.parametrize("bound", [0, 50, 500_000])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_keys_in_tasks_and_in_rounds(spark, monkeypatch, bound, kind):
    monkeypatch.setattr(contraction, "KEY_LINKS", bound)
    rng = random.Random(3)
    links = [(f"k{k}", rng.randrange(n), rng.randrange(n)) for k, n in enumerate([5, 90, 400, 3000] * 5) for _ in range(n // 2)]
    links += [("chain", i, i + 1) for i in rng.sample(range(3000), 3000)] + [("k0", None, 1), (None, 1, 2), ("alone", 3, 3)]
    if kind == "string":
        links = [(k, *(x if x is None else f"é{x}" if x % 7 == 0 else f"n{x}" for x in ends)) for k, *ends in links]
    df = spark.createDataFrame(links, f"key string, a {kind}, b {kind}").repartition(4)
    rows = contraction.key_labels(df, ["key"], xnet.cut).collect()
    assert len(rows) == len({(r.key, r.node) for r in rows})
    assert {(r.key, r.node): r.label for r in rows} == plain([x for x in links if x[0]])


def test_small_keys_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(contraction, "MAX_ROUNDS", 0)
    found = devices(spark, [("s", i, [(i, 0), (i + 1, 0)], None) for i in range(100)])
    assert {r.group for r in geometry.connected_groups(found, ["sheet"], xnet.cut).collect()} == {0}
