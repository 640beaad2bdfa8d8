"""Queries do the work that their result needs, and once."""

import os

import pytest

from copperline.plans import projection, registry
from copperline.sources import altium

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


def test_problems_rank_the_pins_once(spark, monkeypatch):
    asked, ranked = [], projection.ranked_pins
    monkeypatch.setattr(projection, "ranked_pins", lambda *a: asked.append(1) or ranked(*a))
    found = registry.netlist_problems(spark, DATA)
    assert len(asked) == 1 and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["altium_components", "altium_varied_components"])
def test_components_are_read_without_connecting_nets(spark, monkeypatch, name):
    def connects(*a):
        raise AssertionError("nets are connected")

    monkeypatch.setattr(altium, "sheet_nets", connects)
    assert registry.queries()[name](spark, DATA).count() > 0
