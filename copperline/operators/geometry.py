"""Spatial joins of schematic devices and their connected groups.

A device is a row with a key (a sheet, or a design and a sheet), ``idx`` and ``points``, an array of (x, y). Its
segments run between consecutive points; a single point is a segment of no length. Two devices touch if an end
of a segment of one lies in the bounding box of a segment of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperline.operators.contraction import key_labels

#: Side of a cell of the finest grid, in units of a ten-thousandth; each level's cells are twice as wide as the last's.
CELL = 10_000


def segments(devices: DataFrame, key: list[str]) -> DataFrame:
    """(key, idx, x1, y1, x2, y2): the ends of each segment, as drawn."""
    p = F.col("points")
    pairs = F.when(F.size(p) > 1, F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b"))).when(F.size(p) == 1, F.arrays_zip(p.alias("a"), p.alias("b")))
    rows = devices.select(*key, "idx", F.explode(pairs).alias("s"))
    return rows.select(*key, "idx", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def ends(devices: DataFrame, key: list[str]) -> DataFrame:
    """(key, idx, x, y): the places where segments of a device end, each once, which are its points."""
    rows = devices.select(*key, "idx", F.explode(F.array_distinct("points")).alias("e"))
    return rows.select(*key, "idx", F.col("e.x").alias("x"), F.col("e.y").alias("y"))


def _level(extent: Column) -> Column:
    """The grid whose cells are as wide as a box at least, so that it covers two of them a side and four in all at most."""
    return F.greatest(F.ceil(F.log2(extent / CELL)), F.lit(0)).cast("int")


def _cell(place: Column) -> Column:
    return F.floor(place / (F.pow(F.lit(2.0), F.col("level")) * CELL)).cast("long")


def boxes_by_cell(seg: DataFrame, key: list[str]) -> DataFrame:
    """(key, box, lx, hx, ly, hy, level, cx, cy): bounding boxes of segments, at most four rows each."""
    rows = seg.select(*key, F.col("idx").alias("box"), F.least("x1", "x2").alias("lx"), F.greatest("x1", "x2").alias("hx"), F.least("y1", "y2").alias("ly"), F.greatest("y1", "y2").alias("hy"))
    rows = rows.withColumn("level", _level(F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"))))
    for side, low, high in (("cx", "lx", "hx"), ("cy", "ly", "hy")):
        rows = rows.withColumn(side, F.explode(F.sequence(_cell(F.col(low)), _cell(F.col(high)))))
    return rows


def ends_by_cell(ends: DataFrame, levels: list[int]) -> DataFrame:
    """Ends with their cell on each of the levels."""
    rows = ends.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    return rows.withColumns({"cx": _cell(F.col("x")), "cy": _cell(F.col("y"))})


def touching(devices: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b), a < b: pairs of devices that touch.

    Boxes are dealt to the cells they cover on the grid of their own size, and segment ends to their one cell on each
    grid that some box uses, so the join is on equal cells; each end and box meet in one cell only.
    """
    return _held(ends(devices, key).withColumnRenamed("idx", "tip"), segments(devices, key), key).distinct()


def _held(tips: DataFrame, seg: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b) of tips (key, tip, x, y) that lie in the bounding box of a segment of another device."""
    boxes = boxes_by_cell(seg, key)
    levels = sorted(r.level for r in boxes.select("level").where("level IS NOT NULL").distinct().collect())  # a few dozen
    tips = ends_by_cell(tips, levels) if levels else tips.withColumns({c: F.lit(None).cast(t) for c, t in (("level", "int"), ("cx", "long"), ("cy", "long"))})
    met = tips.join(boxes, [*key, "level", "cx", "cy"]).where(F.col("x").between(F.col("lx"), F.col("hx")) & F.col("y").between(F.col("ly"), F.col("hy")) & (F.col("tip") != F.col("box")))
    return met.select(*key, F.least("tip", "box").alias("a"), F.greatest("tip", "box").alias("b"))


def linked(devices: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b): links that connect the same devices as ``touching``, a star for each place where ends lie.

    The first device with an end at a place stands for all of them, so a bus point of n devices gives n links and
    not n * n; only this one device's end meets the boxes that hold the place. A link may be there twice.
    """
    seg = segments(devices, key)
    tips = ends(devices, key).where("x IS NOT NULL AND y IS NOT NULL").withColumn("first", F.min("idx").over(Window.partitionBy(*key, "x", "y")))
    star = tips.where("idx <> first").select(*key, F.col("first").alias("a"), F.col("idx").alias("b"))
    spots = tips.where("idx = first").select(*key, "x", "y", "first")
    long = seg.where("x1 <> x2 OR y1 <> y2")  # a box of no extent is its own end
    held = _held(spots.withColumnRenamed("first", "tip"), long, key)
    return star.unionByName(held)


def same_text(devices: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b): devices that are named globally (column ``label``) and share the name, each linked with the first."""
    named = devices.where("label IS NOT NULL AND label <> ''").select(*key, "idx", "label")
    first = named.groupBy(*key, "label").agg(F.min("idx").alias("a"))
    return named.join(first, [*key, "label"]).where("a <> idx").select(*key, "a", F.col("idx").alias("b"))


def connected_groups(devices: DataFrame, key: list[str], cut) -> DataFrame:
    """(key, idx, group): the smallest idx that each device is connected with, through any number of others."""
    edges = linked(devices, key).unionByName(same_text(devices, key))
    labels = key_labels(edges, key, cut).withColumnRenamed("node", "idx")
    return devices.select(*key, "idx").join(labels, [*key, "idx"], "left").select(*key, "idx", F.coalesce("label", "idx").alias("group"))
