"""Hard negatives against plain integer products, over rows of all kinds and small blocks."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copperline.llm import negatives


def plain(rows, every=100, k=(5, 5), low=80, high=100):
    """The contract, row by row: rows are (vec_id, label, vector)."""
    sound = [r for r in rows if None not in r and len(r[2]) and all(x is not None and math.isfinite(x) for x in r[2])]
    lengths = [len(r[2]) for r in sound]
    width = min(set(lengths), key=lambda w: (-lengths.count(w), w)) if sound else 0
    whole = {}
    for i, label, v in sorted((r for r in sound if len(r[2]) == width), key=lambda r: (r[0], list(r[2]), r[1])):
        whole.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, (_, w) in whole.items() if i != a)
        for p, i in [(p, i) for p, i in scored if whole[i][0] == label][: k[0]]:
            fit = [(n, j) for n, j in scored if whole[j][0] != label and low * -p <= 100 * -n <= high * -p][: k[1]]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(table, **how).collect())


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 70), st.integers(1, 12), st.sampled_from([1, 3, 300, 1 << 20, 1 << 27]), st.integers(1, 4))
def test_planes_find_the_best_of_every_window(seed, n, width, size, k):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-size, size + 1, (n, width))
    vectors[rng.random(n) < 0.3] = vectors[0]
    asked = rng.integers(-size, size + 1, (3, width))
    query = np.array([0, 0, 1, 2, 2, 2])
    scores = asked @ vectors.T
    ends = np.sort(rng.choice(scores.ravel(), (6, 2)), 1)
    bottom = int(min(vectors.min(), 0))
    own = negatives.Sliced.of(vectors, -bottom, max(1, int(vectors.max() - bottom).bit_length()))
    fits = rng.random((3, n)) < 0.8
    everything = negatives.Searches(np.arange(3), np.zeros(3), asked, np.arange(3), np.full(3, -negatives._FAR), np.full(3, negatives._FAR), np.arange(3))
    windows = negatives.Searches(np.arange(3), np.zeros(3), asked, query, ends[:, 0], ends[:, 1], np.arange(6))
    for case in (everything, windows):
        search, row, score = negatives.scan(case, np.arange(3), own, fits, np.full(len(case.low), -negatives._FAR), k)
        best = negatives.best_of(search, score, row, k)
        got = sorted(zip(search[best].tolist(), row[best].tolist(), score[best].tolist(), strict=True))
        wanted = []
        for s, (q, low, high) in enumerate(zip(case.query, case.low, case.high, strict=True)):
            fit = sorted((-int(scores[q, i]), i) for i in range(n) if fits[q, i] and low <= scores[q, i] <= high)[:k]
            wanted += [(s, i, -v) for v, i in fit]
        assert got == sorted(wanted)


@pytest.mark.parametrize("chunk", [7, 4096])
def test_rows_of_all_kinds(spark, monkeypatch, chunk):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), (rng.standard_normal(6) / 2).tolist()) for i in range(400)]
    rows[0] = (0, 1, rows[1][2])
    rows += [(1000 + i, i % 2, [0.5] * 6) for i in range(40)]  # ties
    rows += [(2000, None, [0.1] * 6), (2100, 1, None), (2200, 1, []), (2300, 1, [0.1, None] + [0.2] * 4), (2400, 1, [float("nan")] * 6), (2500, 1, [float("inf")] + [0.0] * 5)]
    rows += [(2600, 2, [0.0] * 6), (2700, 7, [0.3] * 6), (None, 1, [0.4] * 6), (2800, 1, [0.4] * 5), (300, 2, [0.9] * 6), (300, 0, [-0.9] * 6), (300, 1, [-0.9] * 6), (2900, -4, [-1.0, 1.0, -1.0, 1.0, 1e-9, -1e-9])]
    monkeypatch.setattr(negatives, "QUERIES", 2)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 9)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_large_integer_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (rng.integers(-(1 << 17), 1 << 17, 4) + rng.random(4)).tolist()) for i in range(120)]
    assert mined(spark, rows, every=10) == plain(rows, every=10)
    with pytest.raises(ArithmeticError):
        mined(spark, [(0, 1, [1e300, 0.0]), (1, 1, [1.0, 0.0])])


def test_parameters_and_clashing_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 4, rng.standard_normal(5).tolist()) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    table = table.select(F.col("vec_id").alias("key"), F.col("label").alias("kind"), F.col("embedding").alias("v"), F.lit("x").alias("vec_id"), F.lit(0).alias("score"), F.lit(0).alias("rank"), F.lit(0).alias("segment"))
    got = negatives.hard_negatives(table, 50, 3, 2, -50, 90, "key", "v", "kind")
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 50, (3, 2), -50, 90)


def test_nothing_to_do(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, None)]) == []
    assert mined(spark, [(0, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.45])]) == plain([(0, 1, [1.0]), (1, 1, [0.5]), (2, 2, [0.45])])
