"""Greedy matching in rounds and by components against the plain rule."""

import random

import pytest

from copperline.operators import matching


def plain(rows):
    used, out = set(), set()
    for key, design, data_set, score in sorted(set(rows), key=lambda r: (-r[3], r[1], r[2])):
        if (key, 0, design) not in used and (key, 1, data_set) not in used:
            used |= {(key, 0, design), (key, 1, data_set)}
            out.add((key, design, data_set, score))
    return out


def chain(key, n):
    return [(key, f"d{i:05}", f"s{i + k:05}", 2 * i + k) for i in range(n) for k in (0, 1)]


@pytest.mark.parametrize("bound", [150, 1 << 18])
def test_chains_and_tangles(spark, monkeypatch, bound):
    monkeypatch.setattr(matching, "COMPONENT_PAIRS", bound)
    rng = random.Random(9)
    n = 12 if bound == 150 else 400
    rows = chain("x", 70) + chain("y", n) + [("x", f"e{rng.randrange(30):02}", f"t{rng.randrange(30):02}", rng.randrange(5)) for _ in range(120)]
    rounds = []
    monkeypatch.setattr(matching, "cut", lambda df, own=matching.cut: rounds.append(1) or own(df))
    got = {tuple(r) for r in matching.greedy(spark.createDataFrame(rows, "k string, design string, data_set string, score int").repartition(3), ["k"]).collect()}
    assert got == plain(rows) and len(rounds) < 60


def test_nothing_to_match(spark):
    assert matching.greedy(spark.createDataFrame([], "k string, design string, data_set string, score int"), ["k"]).collect() == []
