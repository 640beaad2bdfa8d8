"""Registered queries answer for all of their input, against brute force on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.plans import projection, registry

DATA = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


def off_ground(rows):
    return rows.where(~exprs.is_ground(F.col("net")))


def test_every_sheet_is_joined(spark, tmp_path):
    lines = [(s, o, p, n) for s in (3, 40, 41, 977) for o in (1, 2, 301) for p in (5, 205) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")

    def box(o, p, n):
        x, y = o % 300 * 1000, p % 200 * 1000
        return x, y, x + 4000 * (n % 2 == 0), y + 15000 * (n % 3 == 0)

    def holds(a, b):
        return any(b[0] <= x <= b[2] and b[1] <= y <= b[3] for x, y in (a[:2], a[2:]))

    want = set()
    for s, *a in lines:
        for t, *b in lines:
            first, second = ("-".join(map(str, k)) for k in (a, b))
            if s == t and first < second and (holds(box(*a), box(*b)) or holds(box(*b), box(*a))):
                want.add((str(s), first, second))
    got = [tuple(r) for r in registry.queries()["spatial_connect"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {s for s, *_ in want} == {"3", "40", "41", "977"}


@supplied
def test_every_net_off_ground_is_traced(spark):
    nets = {r.net for r in off_ground(projection.netlist(spark, DATA).nets).collect()}
    for name in ("xnet_visited", "xnet_envelope"):
        assert {r.root for r in registry.queries()[name](spark, DATA).select("root").distinct().collect()} == nets
    assert {r.root for r in registry.flagship(spark, DATA).select("root").distinct().collect()} == {
        r.root for r in registry.queries()["xnet_from_net"](spark, DATA).select("root").distinct().collect()
    }


@supplied
def test_every_pin_off_ground_is_asked(spark):
    """A part that is stuffed shows itself, whichever of its pins is asked."""
    net = projection.netlist(spark, DATA)
    stuffed = {r.refdes for r in registry.dns_flags(spark, DATA).where("not dns").collect()}
    pins = {(r.refdes, r.pin, r.net) for r in off_ground(net.component_pins).collect() if r.refdes in stuffed}
    got = registry.queries()["xnet_from_pin"](spark, DATA).where("start_refdes = part").select("start_refdes", "start_pin", "root").distinct().collect()
    assert pins and pins <= {tuple(r) for r in got}
