"""One-to-one assignment of designs and data sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperline.functions import exprs
from copperline.operators.contraction import star_labels
from copperline.operators.xnet import cut

#: Pairs of a component that one task takes in their order.
COMPONENT_PAIRS = 1 << 18
#: A round that decides fewer than one in so many pairs is slow.
SLOW = 4


def _in_order(pairs: DataFrame, key: list[str], label: str, rank: list) -> DataFrame:
    """The pairs (key, design, data_set, score) that taking the best one first chooses, each component in one task, streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, (set(), set())
        for batch in batches:
            keep = []
            for component, design, data_set in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if component != at:
                    at, used = component, (set(), set())
                keep.append(design not in used[0] and data_set not in used[1])
                if keep[-1]:
                    used[0].add(design)
                    used[1].add(data_set)
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["component"])

    component = F.to_json(F.struct(*key, label)).alias("component")
    rows = pairs.select(component, F.col("design").cast("string").alias("d"), F.col("data_set").cast("string").alias("s"), *[r.alias(f"r{k}") for k, r in enumerate(rank)], *key, "design", "data_set", "score")
    rows = rows.repartition("component").sortWithinPartitions("component", *[f"r{k}" for k in range(len(rank))]).drop(*[f"r{k}" for k in range(len(rank))])
    out = rows.drop("component", "d", "s")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return rows.mapInArrow(run, f"d string, s string, {ddl}").select(*out.columns)


def greedy(candidates: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (key, design, data_set, score) that taking the best remaining pair first would choose.

    Best: the highest score, then design and data set in collated order. A pair that is the best left of both its
    sides is chosen by the greedy order whatever else is chosen, so all such pairs are taken at once, their sides
    leave, and so on. Rounds see only pairs whose sides are both free.

    Long falling chains of pairs make slow rounds. After one, the pairs that are left are parted into connected components,
    which do not touch each other: those of up to ``COMPONENT_PAIRS`` pairs are settled in their order, a component by a
    task that holds its chosen sides, and rounds go on with the rest.
    """
    rank = [-F.col("score"), exprs.collated(F.col("design")), exprs.collated(F.col("data_set")), F.col("design").cast("string"), F.col("data_set").cast("string")]
    best_first = F.struct(*[r.alias(f"r{k}") for k, r in enumerate(rank)])
    left = cut(candidates.select(*key, "design", "data_set", "score").distinct())
    n = left.count()
    part_at = n  # components are looked for again only when half of these pairs are gone
    chosen: list[DataFrame] = []
    while n:
        order = Window.partitionBy(*key, "design").orderBy(best_first)
        other = Window.partitionBy(*key, "data_set").orderBy(best_first)
        best = left.withColumns({"by_design": F.row_number().over(order), "by_set": F.row_number().over(other)}).where("by_design = 1 AND by_set = 1")
        best = cut(best.select(*key, "design", "data_set", "score"))
        chosen.append(best)
        left = cut(left.join(best.select(*key, "design"), [*key, "design"], "left_anti").join(best.select(*key, "data_set"), [*key, "data_set"], "left_anti"))
        was, n = n, left.count()
        if n and (was - n) * SLOW < was and n <= part_at:
            part_at = n // 2
            node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
            labels = star_labels(left.select(*key, node("d ", "design").alias("a"), node("s ", "data_set").alias("b")), key, cut)
            labelled = cut(left.withColumn("node", node("d ", "design")).join(labels, [*key, "node"]))
            small = labelled.groupBy(*key, "label").agg(F.count("*").alias("c")).where(F.col("c") <= COMPONENT_PAIRS).select(*key, "label")
            chosen.append(cut(_in_order(labelled.join(small, [*key, "label"], "left_semi"), key, "label", rank)))
            left = cut(labelled.join(small, [*key, "label"], "left_anti").select(*key, "design", "data_set", "score"))
            n = left.count()
    return reduce(DataFrame.unionByName, chosen, left.limit(0)) if chosen else left
