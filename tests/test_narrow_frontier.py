"""Traversals go on alike from narrow and wide frontiers; circuits and pins are computed once."""

import os
import random

import pytest

from copperline.operators import xnet
from copperline.plans import projection, registry
from copperline.plans.netlist import from_rows

DATA = "/root/testdata/sf0.001"


def test_narrow_and_wide_frontiers_agree(spark, monkeypatch):
    rng = random.Random(8)
    nets = ["GND", "+3V3", *[f"N{k}" for k in range(12)]]
    net = from_rows(spark, {"d": {"components": {f"{rng.choice('RCLU')}{k}": {"pins": {str(p): rng.choice(nets) for p in (1, 2, 3)[: rng.randint(2, 3)]}} for k in range(14)}}})
    starts = xnet.starts_of(spark, [("d", n) for n in nets])
    narrow = sorted(xnet.reach(net, starts).collect())
    monkeypatch.setattr(xnet, "NARROW", 0)
    assert sorted(xnet.reach(net, starts).collect()) == narrow and max(r.hop for r in narrow) > 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")
def test_envelopes_need_circuits_once(spark, monkeypatch):
    made = registry.xnet_envelope(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Window [") == 1


def test_both_ends_of_a_part_in_one_order(spark, tmp_path):
    prices = {1: [5.0, 5.0, 2.0, 9.0, 9.0], 2: [None, 3.0], 3: [None, None], 4: [7.0]}
    rows = [(p, 10 * p + k, k % 2, k, x) for p, xs in prices.items() for k, x in enumerate(xs)]
    spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    part = spark.createDataFrame([(p, "SMALL") for p in prices], "p_partkey long, p_type string")
    pins = projection.ranked_pins(spark, str(tmp_path), part)
    assert pins._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    got = {(r.l_partkey, r.pin): r.l_orderkey for r in pins.collect()}
    assert got == {(1, "1"): 12, (1, "2"): 13, (2, "1"): 20, (2, "2"): 21, (3, "1"): 30, (3, "2"): 30, (4, "1"): 40, (4, "2"): 40}
