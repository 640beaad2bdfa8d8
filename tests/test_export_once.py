"""Text exports are written and read once, and in runs; places within keys of any width; texts are trimmed only if they need it."""

import io
import os
import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_splits import MORE_NETS, as_lines

from copperline.functions import exprs
from copperline.operators import ordering
from copperline.operators.xnet import cut
from copperline.plans import drawn, fleet, projection
from copperline.sources import cadence, designs, splits

DATA = "/root/testdata/sf0.001"
supplied = pytest.mark.skipif(not os.path.isdir(DATA), reason="the supplied tables are not here")


@supplied
def test_the_source_is_read_once_for_a_question(spark, monkeypatch, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    lines_of_index = designs.export_lines

    def lines(*a):
        read = lines_of_index(*a)

        def count(batches):
            for b in batches:
                (seen / uuid.uuid4().hex).write_text(str(b.num_rows))
                yield b

        return read.mapInArrow(count, read.schema)

    monkeypatch.setattr(designs, "export_lines", lines)
    made = fleet.design_source(spark, DATA)
    n = made.count()
    read = sum(int(p.read_text()) for p in seen.iterdir())
    lines_in_all = projection.cadence_lines(spark, DATA).count()
    assert n and lines_in_all < read < 3 * lines_in_all  # all designs, and one of them again


@supplied
def test_pins_of_an_export_are_ranked_before_lines_are_made(spark):
    plan = projection.cadence_lines(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan


def test_runs_begin_where_any_column_changes():
    columns = [pa.array(["a", "a", "b", "b", "b"]), pa.array(["x", "x", "x", "y", "y"]), pa.array([0, 0, 0, 0, 1])]
    assert drawn.run_starts(columns) == [0, 2, 3, 4] and drawn.run_starts([pa.array([], pa.string())]) == []


@pytest.mark.parametrize("read", [1, 3, 1 << 20])
def test_batches_hold_the_lines_of_the_splits(monkeypatch, read):
    monkeypatch.setattr(splits, "READ", read)
    monkeypatch.setattr(splits, "BATCH", 3)
    for data in (b"", b"\n", b"a", b"\n\na\n\nbb", b"abc\ndef\n\n", b"\xff\n\xc3\xa9\n\xc3", MORE_NETS.encode()[:200]):
        for split in (1, 2, 5, 400):
            for start in range(0, len(data), split):
                wanted = [(at, x.decode("utf-8", "replace")) for at, x in splits.split_lines(io.BytesIO(data), len(data), start, split)]
                made = [splits.batch("d", "k", 7, *b) for b in splits.line_batches(io.BytesIO(data), len(data), start, split)]
                assert [x for b in made for x in zip(b["at"].to_pylist(), b["line"].to_pylist(), strict=True)] == wanted
                assert all(0 < b.num_rows <= 3 and set(b["block"].to_pylist()) == {7} for b in made)


def test_wide_and_narrow_keys_are_numbered_alike(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(None if i % 40 == 0 else "hot" if i % 3 else f"k{i % 50}", rng.choice([None, rng.randrange(10**6)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x long, i long")
    got = []
    for n in (10, 500_000):
        monkeypatch.setattr(ordering, "KEY_ROWS", n)
        got.append(sorted(map(repr, ordering.numbered(df, ["k"], ["x", "i"], "place", cut).select("k", "i", "place").collect())))
    assert got[0] == got[1] and len(got[0]) == sum(k is not None for k, _, _ in rows)
    plan = ordering.numbered(df, ["k"], ["x", "i"], "place", cut)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan  # a narrow key is the work of one task


@pytest.mark.parametrize("wide", [0, 500_000])
def test_nets_of_wide_and_narrow_nets(spark, monkeypatch, wide):
    monkeypatch.setattr(ordering, "KEY_ROWS", wide)
    lines = cut(as_lines(spark, {"pstxnet": MORE_NETS}, 13))
    got = sorted(repr(tuple(r)) for r in splits.nets(lines).select("design_id", "net", "net_ord", "refdes", "ref_ord", "pin", "pin_ord").collect())
    assert got == sorted(repr((d, *row)) for d, text in (("a", MORE_NETS), ("b", MORE_NETS[::2])) for row in cadence.net_rows(text))


def test_trimmed_texts(spark):
    texts = ["", " ", "a", " a", "a\t", "﻿a b ", "é ", "é", "a\n", "\x0b~!", "!　", "a é", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exprs.trimmed(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == {t: None if t is None else t.strip(cadence._SPACE) for t in texts}
