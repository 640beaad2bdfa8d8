"""Connected components by alternating large-star and small-star contraction.

Links are rows (key, a, b); nodes of different keys are never connected, and nodes are ordered as their type is. A
large star links each of a node's larger neighbours with the least node around it, a small star does so with the smaller
ones and the node itself. Alternating, links turn into one star for each component, around its least node.

A hub, a node with a large share of all links, is no group of one task anywhere: least nodes come out of partial
aggregates, and they meet the links again by a join on the node, in which hubs are a broadcast table of their own. It has
fewer than ``HUBS`` rows at any size, as no more nodes can have over 1 / ``HUBS`` of all rows.

``key_labels`` gives the same labels where links come in many keys: a key of few links is contracted by the task that holds
it, and only the others go through rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node is a hub with more than this share of all rows (one in so many), and this many rows.
HUBS, HUB_ROWS = 512, 20_000
MAX_ROUNDS = 200
#: Links of one key that a task holds at once; a key with more goes through rounds.
KEY_LINKS = 500_000

Cut = Callable[[DataFrame], DataFrame]


def with_least(rows: DataFrame, on: list[str], column: str, name: str, n_rows: int) -> DataFrame:
    """The ``n_rows`` rows with the least ``column`` of all rows that agree in ``on``, as ``name``; rows with a null there go.

    ``rows`` is read more than once, so it should be cut or stored.
    """
    least = rows.groupBy(*on).agg(F.min(column).alias(name), F.count("*").alias("n_alike"))
    bound = max(HUB_ROWS, n_rows // HUBS)
    if n_rows <= bound:
        return rows.join(least.drop("n_alike"), on)
    hubs = F.broadcast(least.where(F.col("n_alike") > bound).drop("n_alike").withColumnRenamed(name, "of_hub"))
    met = rows.join(hubs, on, "left")
    plain = met.where("of_hub IS NULL").drop("of_hub").join(least.where(F.col("n_alike") <= bound).drop("n_alike"), on)
    return plain.unionByName(met.where("of_hub IS NOT NULL").withColumnRenamed("of_hub", name))


def _state(links: DataFrame, key: list[str]) -> tuple[int, object]:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64(*key, "a", "b").cast("decimal(38, 0)"))).first())


def star_labels(links: DataFrame, key: list[str], cut: Cut) -> DataFrame:
    """(key, node, label) of every node that some link of two different nodes has: the least node of its component.

    ``cut`` cuts lineage, by a checkpoint or a stored table. Rows with a null end are ignored, and so are repeated ones.
    """
    a, b = F.col("a"), F.col("b")
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*key, F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    links = cut(ends.distinct())  # a > b from here on
    was, now = None, _state(links, key)
    for _ in range(MAX_ROUNDS):
        if now == was:
            stars = links.select(*key, a.alias("node"), b.alias("label"))
            return stars.unionByName(links.select(*key, b.alias("node"), b.alias("label")).distinct())
        both = links.unionByName(links.select(*key, b.alias("a"), a.alias("b")))
        around = with_least(both, [*key, "a"], "b", "m", 2 * now[0]).withColumn("m", F.least("m", "a"))
        large = cut(around.where("b > a AND b <> m").select(*key, b.alias("a"), F.col("m").alias("b")).distinct())
        below = with_least(large, [*key, "a"], "b", "m", 2 * now[0])
        small = below.select(*key, F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("l")).select(*key, "l.a", "l.b")
        links = cut(small.where("a <> b").distinct())
        was, now = now, _state(links, key)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def key_labels(links: DataFrame, key: list[str], cut: Cut) -> DataFrame:
    """What ``star_labels`` gives, for links in any number of keys, most of them small.

    Keys with over ``KEY_LINKS`` links are a broadcast table: no more of them are there than links / ``KEY_LINKS``.
    """
    whole = F.col("a") != F.col("b")
    for k in key:
        whole = whole & F.col(k).isNotNull()
    links = cut(links.where(whole).select(*key, "a", "b"))
    wide = cut(links.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > KEY_LINKS).select(*key))
    if wide.isEmpty():
        return _in_tasks(links, key)
    of_wide = lambda how: links.join(F.broadcast(wide), key, how)
    return _in_tasks(of_wide("left_anti"), key).unionByName(star_labels(of_wide("left_semi"), key, cut))


def _in_tasks(links: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, label) of links whose keys are each held by a task, one after the other."""
    node = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = (pa.concat_tables([held, new]) if held else new).combine_chunks()
            begins = np.flatnonzero(_begins(held, key))
            if begins[-1]:
                yield from _labels(held.slice(0, begins[-1]), key)
                held = held.slice(begins[-1])
        if held:
            yield from _labels(held, key)

    fields = [f"`{k}` {links.schema[k].dataType.simpleString()}" for k in key]
    return links.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ", ".join([*fields, f"node {node}", f"label {node}"]))


def _begins(rows: pa.Table, key: list[str]) -> np.ndarray:
    """Whether a key begins at each row of rows that stand key by key."""
    begins = np.zeros(len(rows), bool)
    begins[0] = True
    for k in key:
        column = rows[k].combine_chunks()
        begins[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
    return begins


def _labels(rows: pa.Table, key: list[str]) -> Iterator[pa.RecordBatch]:
    """The labels of whole keys: each round hooks the roots of linked nodes on the lesser one and shortens all paths."""
    begins = _begins(rows, key)
    names = pa.chunked_array([*rows["a"].chunks, *rows["b"].chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner = np.tile(np.cumsum(begins) - 1, 2)
    nodes, ends = np.unique(owner * len(order) + rank[names.indices.to_numpy()], return_inverse=True)
    a, b = ends[: len(rows)], ends[len(rows) :]
    label = np.arange(len(nodes))
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    of_key = np.flatnonzero(begins)[nodes // len(order)]
    said = lambda n: names.dictionary.take(pa.array(order[n % len(order)]))
    columns = [*(rows[k].combine_chunks().take(pa.array(of_key)) for k in key), said(nodes), said(nodes[label])]
    yield from pa.Table.from_arrays(columns, names=[*key, "node", "label"]).to_batches(max_chunksize=10_000)
