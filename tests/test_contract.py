"""The rules of records and of the netlist's tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from copperline.plans.netlist import from_rows
from copperline.sources import altium


def test_record_faults(spark):
    props = [
        ("1", {}), ("2", {}), ("34", {"Text": ""}), ("34", {"Text": "R1", "Name": "Designator"}), ("34", {"Text": "R1", "Name": "Label"}),
        ("34", {"Name": "Label"}), ("41", {"Text": "x"}), ("41", {"Name": ""}), ("17", {}), ("17", {"Text": "GND"}), ("25", {"Name": "A"}), ("29", {}), ("99", {}),
    ]
    rows = spark.createDataFrame([("d", "s", 0, k, kind, None, p) for k, (kind, p) in enumerate(props)], "design_id string, sheet string, sheet_ord int, idx long, kind string, owner long, props map<string,string>")
    found = sorted((r.idx, r.fault) for r in altium.record_faults(rows).collect())
    assert found == [(4, "Name is not Designator"), (5, "Name is not Designator"), (5, "Text is missing"), (6, "Name is missing"), (8, "Text is missing"), (10, "Text is missing")]
    bad = {i for i, _ in found}
    for kind in {k for k, _ in props}:
        valid = {r.idx for r in rows.where(altium.valid_records(rows, kind)).collect()}
        assert valid == {i for i, (k, _) in enumerate(props) if k == kind} - bad
    assert altium.record_faults(rows.limit(0)).isEmpty()


def test_a_netlist_is_validated_by_columns_and_rows(spark):
    net = from_rows(spark, {"d": {"components": {"R1": {"mpn": "X", "pins": {"1": "A", "2": "B"}}}}})
    more = replace(net, nets=net.nets.withColumn("extra", F.lit(1)))
    assert not more.column_faults() and more.validated().nets.columns == net.nets.columns
    other = replace(net, nets=net.nets.withColumn("net_ord", F.col("net_ord").cast("int")), components=net.components.drop("mpn"))
    assert other.column_faults() == ["components.mpn is missing", "nets.net_ord is int and not bigint"] and other.validated() is None
    twice = replace(net, nets=net.nets.union(net.nets))
    assert not twice.column_faults() and twice.validated() is None
    assert replace(net, components=net.components.where("false")).validated() is not None
