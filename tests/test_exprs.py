import pytest
from pyspark.sql import functions as F

from copperline.functions import exprs


def values(spark, texts, make):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", make(F.col("t")).alias("v"))
    return [r.v for r in rows.orderBy("k").collect()]


@pytest.mark.parametrize(
    ("make", "yes", "no"),
    [
        (exprs.is_ground, ["GND", "gnd", "VSS", "AGND", "cgnd"], ["GND1", "GND\n", "XGND", "", "VCC"]),
        (exprs.is_power, ["VCC", "vdd_3v3", "+3V3", "-12V", "5V0", "PWR_A", "RAIL_1", "PP3V3", "LD_PN1", "VBUS2", "+X", "3V"], ["PWR_", "SIG", "V", "GND", "+", "N100", "RAIL_", "12"]),
        (exprs.is_stop, ["GND", "+5V", "VIN"], ["SDA", "NET1"]),
        (exprs.is_passive, ["R1", "rs2", "C3", "L1", "FB1", "FR2", "LED1", "CON1"], ["U1", "J1", "Q3", "F1", "D1"]),
        (exprs.is_refdes, ["U1", "r1_a", "A"], ["1U", "@L.S(X):I@P", "U-1", "", "U1\n"]),
    ],
)
def test_classifiers(spark, make, yes, no):
    assert values(spark, yes + no, make) == [True] * len(yes) + [False] * len(no)


def test_dns_reads_all_but_the_value(spark):
    rows = [("a DNP b", None, None), (None, "do  not stuff", None), (None, None, "NO POP"), ("DNSX", None, None), (None, None, None), (None, "not populated", None), ("DO", "NOT", "INSTALL")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, m string, d string, c string")
    got = [r.v for r in df.select("k", exprs.is_dns(F.col("m"), F.col("d"), F.col("c")).alias("v")).orderBy("k").collect()]
    assert got == [True, True, True, False, False, True, True]


def test_trim_takes_every_space(spark):
    assert values(spark, ["  a\t", "﻿　x\n", " ", ""], exprs.filled) == ["a", "x", None, None]


def test_natural_order(spark):
    df = spark.createDataFrame([(["U10", "U2", "u1a", "U1", "U", "A-1", "A1", "10", "9"],)], "v array<string>")
    assert df.select(exprs.naturally_sorted(F.col("v"))).first()[0] == ["9", "10", "A1", "A-1", "U", "U1", "u1a", "U2", "U10"]


def test_collation_differs_from_code_points(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "A", "a", "B", "+3V3", "GND"]], "v string")
    assert [r.v for r in df.orderBy(exprs.collated(F.col("v"))).collect()] == ["+3V3", "a", "A", "b", "B", "GND"]


def test_map_order_puts_indexes_first(spark):
    keys = ["A1", "10", "2", "01", "4294967295", "0"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(keys)], "o long, v string")
    assert [r.v for r in df.orderBy(exprs.map_order(F.col("v"), F.col("o"))).collect()] == ["0", "2", "10", "A1", "01", "4294967295"]


def test_skip_takes_the_first_type_that_fits(spark):
    assert values(spark, ["C1", "cx", "R1", "FB2"], lambda c: exprs.skip_match(c, ["c", "CX", " fb "])) == ["C", "C", None, "FB"]
    assert values(spark, ["C1"], lambda c: exprs.skip_match(c, ["", "C"])) == [None]
    assert values(spark, ["C1"], lambda c: exprs.skip_match(c, [])) == [None]


def test_prefixes_and_pin_names(spark):
    assert values(spark, ["u12", "FB1A", "123", "_x"], exprs.refdes_prefix) == ["U", "FB", "123", "_X"]
    assert values(spark, [" A ", "1", "", None, "  "], lambda c: exprs.pin_name(F.lit("1"), c)) == ["A", None, None, None, None]
    assert values(spark, ["", "N1"], exprs.connected) == ["NC", "N1"]
