"""Places and carried states in an order that many tasks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one key that a task puts in order at once; a key with more is dealt to many tasks by ranges.
KEY_ROWS = 500_000


def numbered(rows: DataFrame, key: list[str], order: list[str], name: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with their place among those of their key, from 0, as ``name``; a key may fill any number of tasks. Rows without a key go.

    ``rows`` is read more than once, so it should be cut or stored. Keys with over ``KEY_ROWS`` rows are a broadcast table: no
    more of them are there than rows / ``KEY_ROWS``.
    """
    for k in key:
        rows = rows.where(F.col(k).isNotNull())
    narrow, wide = by_width(rows, key, cut)
    placed = _in_tasks(narrow, key, order, name)
    return placed if wide is None else placed.unionByName(_in_ranges(wide, key, order, name, cut))


def by_width(rows: DataFrame, key: list[str], cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys that a task can hold, and those of the others; None if there are none."""
    wide = cut(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select(*key))
    if wide.isEmpty():
        return rows, None
    return rows.join(F.broadcast(wide), key, "left_anti"), rows.join(F.broadcast(wide), key, "left_semi")


def _in_tasks(rows: DataFrame, key: list[str], order: list[str], name: str) -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def _in_ranges(rows: DataFrame, key: list[str], order: list[str], name: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of few keys, range-partitioned by key and order: a row's number in its part, after the parts before.

    The numbers rise with the part and, within it, row by row. A key and part is a row of a broadcast table.
    """
    dealt = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).withColumn("row", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("part", F.shiftright("row", 33)))  # parts must not change between the two readings
    counts = dealt.groupBy(*key, "part").agg(F.min("row").alias("first_row"), F.count("*").alias("n_part"))
    before = F.sum("n_part").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("n_before", F.coalesce(before, F.lit(0))).drop("n_part")
    placed = dealt.join(F.broadcast(counts), [*key, "part"]).withColumn(name, (F.col("row") - F.col("first_row") + F.col("n_before")).cast("long"))
    return placed.drop("row", "part", "first_row", "n_before")


def carried(rows: DataFrame, key: list[str], block: str, at: str, values: dict[str, Column]) -> DataFrame:
    """The rows with the last of each value that is not null, up to and with their own, in the order of block and ``at`` within the key.

    A block is one task's work. What it leaves to the blocks after it is a row, and these rows are carried on first.
    """
    rows = rows.withColumns({f"said_{n}": v for n, v in values.items()})
    last = rows.groupBy(*key, block).agg(*[F.max_by(f"said_{n}", F.when(F.col(f"said_{n}").isNotNull(), F.col(at))).alias(f"left_{n}") for n in values])
    earlier = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    met = last.select(*key, block, *[F.last(f"left_{n}", ignorenulls=True).over(earlier).alias(f"met_{n}") for n in values])
    inside = Window.partitionBy(*key, block).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"own_{n}": F.last(f"said_{n}", ignorenulls=True).over(inside) for n in values}).join(met, [*key, block], "left")
    rows = rows.withColumns({n: F.coalesce(f"own_{n}", f"met_{n}") for n in values})
    return rows.drop(*[f"{p}_{n}" for p in ("said", "own", "met") for n in values])
