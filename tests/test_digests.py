"""Digests of circuits as streams: batches cut circuits, one circuit holds most parts, memory does not follow its size."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from copperline.operators import grouping


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def parts(spark, rows):
    ddl = "design_id string, root string, refdes string, mpn string, mpn_present boolean, connections array<struct<net:string,pins:array<string>>>"
    return spark.createDataFrame(rows, ddl)


def body(refdes, mpn, known, connections):
    head = {"refdes": refdes} | ({"mpn": mpn} if known else {})
    return json.dumps(head | {"connections": [{"pins": p, "net": n} for n, p in connections]}, separators=(",", ":"), ensure_ascii=False)


def test_circuits_that_batches_cut(spark, small_batches):
    rng = random.Random(8)
    numbers = rng.sample(range(10_000), 400)
    rows, expected = [], {}
    for root, refs in (("hot", numbers), ("é", numbers[:7]), ("one", numbers[:1]), ("p", numbers[:14])):
        made = [(f"R{n}", rng.choice([None, "X", 'a"b']), rng.random() < 0.7, [("A", ["1"]), ("Ü", ["2", "10"])]) for n in refs]
        rows += [("d", root, *m) for m in made]
        text = ",".join(body(*m) for m in sorted(made, key=lambda m: int(m[0][1:])))
        expected[root] = hashlib.sha256(f"[{text}]".encode()).hexdigest()[:16]
    rng.shuffle(rows)
    got = grouping.circuit_hash(parts(spark, rows).repartition(5), ["design_id", "root"]).collect()
    assert {r.root: r.circuit_hash for r in got} == expected and len(got) == 4
    assert grouping.circuit_hash(parts(spark, rows).limit(0), ["design_id", "root"]).count() == 0


def test_a_large_circuit_is_read_once_in_batches(spark):
    """200,000 parts of one circuit: their digest is that of the text in order, without a row that holds it."""
    rows = spark.range(200_000).select(F.lit("d").alias("design_id"), F.concat(F.lit("R"), "id").alias("refdes"), F.lit("X").alias("mpn"), F.lit(True).alias("mpn_present"), F.expr("array(struct('N' AS net, array('1') AS pins))").alias("connections"))
    state = hashlib.sha256(b"[" + ",".join(body(f"R{n}", "X", True, [("N", ["1"])]) for n in range(200_000)).encode() + b"]")
    found = grouping.circuit_hash(rows.repartition(8, "refdes"), ["design_id"])
    assert [r.circuit_hash for r in found.collect()] == [state.hexdigest()[:16]]
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
