"""Runs against a search of every period, texts of awkward forms, and the cost of hard ones."""

from array import array
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copperline.llm import bytesplit, runs

EMPTY = sha256().hexdigest()


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text, rewrite=False):
    words = (text or "").encode().split()
    n = len(words)
    if rewrite and (asked := runs.planted(doc_id, n)):
        a, p = asked
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    own = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    top = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(own), *best, sha256("".join(f"{s},{m},{q}\n" for s, m, q in own).encode()).hexdigest(), sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


repeated = st.tuples(st.lists(st.integers(0, 3), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 3), max_size=9)).map(lambda t: t[0] * t[1] + t[2])


@settings(max_examples=400, deadline=None)
@given(st.lists(repeated, max_size=3).map(lambda parts: sum(parts, [])))
def test_runs_equal_a_search_of_every_period(words):
    codes = np.array(words, np.int64)
    assert runs.repetitions(codes) == plain_runs(words)
    assert runs.repetitions(codes, 2, 2) == plain_runs(words, 2, 2)
    inside = [(a + s, n, q) for a, b in runs.stretches(codes, np.array([0, len(words)])) for s, n, q in runs.repetitions(codes[a:b])]
    assert sorted(inside) == plain_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_edges_are_next_smaller_suffixes(words):
    after, agree = runs.edges(array("q", words))
    n = len(words)
    for i in range(n):
        smaller = next((j for j in range(i + 1, n) if words[j:] < words[i:]), n)
        assert after[i] == smaller
        if smaller < n:
            assert agree[i] == next((k for k in range(n - smaller) if words[i + k] != words[smaller + k]), n - smaller)


class Counted(int):
    compared = 0

    def __eq__(self, other):
        Counted.compared += 1
        return int(self) == int(other)

    __hash__ = int.__hash__


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("words", [[0] * 3000, list(range(3000)), list(range(3000, 0, -1)), fibonacci(3000), list(range(7)) * 400, ([0] * 30 + [1]) * 90, ([0, 1] * 20 + [2]) * 70])
def test_few_symbols_are_compared(words, monkeypatch):
    class Symbols(list):
        def __add__(self, other):
            return Symbols(Counted(x) for x in [*self, *other])

    monkeypatch.setattr(Counted, "compared", 0)
    runs.edges(Symbols(words))
    assert Counted.compared < 4 * len(words)


TEXTS = [
    (1, None), (2, ""), (3, " \t\x0b "), (4, "a"), (5, "go " * 5), (6, "go " * 6), (7, "x a b a b a b a b y"), (8, "a b a b a b a b " * 3 + "c " + "d " * 12),
    (9, "é ü é ü é ü é ü"), (None, "go go go go go go"), (6, "go " * 6), (10, "Go go " * 4), (11, "one two three " * 300 + "end"), (12, "go " * 8 + "stop " * 8),
]


@pytest.mark.parametrize("span", [7, 1 << 19])
@pytest.mark.parametrize("rewrite", [False, True])
def test_awkward_texts(spark, monkeypatch, span, rewrite):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({"n_runs": F.lit("clash"), "start": F.lit(1), "lang": F.lit(None).cast("string")})
    if span == 7:
        monkeypatch.setattr(bytesplit, "SPAN_BYTES", span)
        data, offsets = bytesplit.text_buffer(docs.toArrow().column("text"))
        ids, got = [i for i, _ in TEXTS], []
        for i, j in bytesplit.spans(offsets, span):
            got += runs.described(data, offsets[i : j + 1], ids[i:j], rewrite)
    else:
        got = [tuple(r) for r in runs.periodic_runs(docs, rewrite).collect()]
    assert sorted(map(repr, got)) == sorted(repr(plain_row(i, t, rewrite)) for i, t in TEXTS)


def test_no_rows(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ties_take_the_first_then_the_shorter(spark):
    docs = spark.createDataFrame([(1, "b b b b b b b b x a a a a a a a a")], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 0, 8, 1, 8000)


def test_a_long_periodic_text(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 200_000 + "end"), (2, None)], "doc_id long, text string")
    row = runs.periodic_runs(docs).where("doc_id = 1").first()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 0, 600_000, 3)
    assert row.collapsed_sha256 == sha256(b"alpha beta gamma end").hexdigest() and row.runs_sha256 != EMPTY
