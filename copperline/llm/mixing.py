"""Mixing sources to target weights (operator 10), in DataFrame functions only.

The words of each source, document after document, are one stream, packed into blocks of ``BLOCK`` words (the
last may be shorter). A source's target says how many slots it gets; each slot falls to one of the mix's
output shards by a seeded hash, which is a multinomial draw of the source's count in every shard. Slots are
numbered through the shards; slot j reads block p(j mod n) in epoch j div n, where p is a pseudorandom
permutation of the source's full blocks, a swap-or-not network that is keyed by seed, source and epoch (the
short block comes last in each epoch). The last slot of a source is cut, so that the words taken are the
target rounded down. Slots and the documents' spans meet in a join by (source, block).

An epoch takes every block at most once, and targets end at ``CAP`` times the source's size, so no document is
taken more than CAP times.

Targets: the sources share the words of all of them by weight; one that would be above its cap stays there,
and its excess goes to the rest by weight until none is above. Sorted by cap over weight, the level at which
this ends is the largest of (words left) / (weight left) over the sorted sources.

Scale: only rows (id, source, size) are range-partitioned by (source, id), so a source that holds a third of
all rows spans many partitions, as does one repeated row; prefix sums take two levels (parts of a source, then rows
of a part). Windows that see one partition hold one row per source, or per source and shard. Slots are numbered and
permuted in partitions of ``TASK_SLOTS``, counted from the plan.

Defined results: null or empty text has size 0 and is taken 0 times. Sources order by code point, null last.
Rows with equal ids order by a hash of their text; equal rows are told apart by their place, so each has its
own result. An empty table gives no rows. Long texts count whole. Extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copperline.llm.common import stored

BLOCK = 128
CAP = 3
WEIGHTS = (1, 2, 3)
SHARD_WORDS = 1 << 22
SEED = 20260101
ROUNDS = 24
#: Slots of a source that are numbered in one row's explode.
RUN = 4096
#: Slots of a partition.
TASK_SLOTS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not: a permutation of 0..n-1 for each key."""

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        high = F.greatest(x, other)
        return F.when(F.xxhash64(key, i, high, F.lit(1)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, swap)


def source_targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(skey, source_size) with weight and target; one row per source, so one-partition windows are small."""
    order = Window.orderBy("skey")
    every = Window.partitionBy()
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", cycle).withColumns({"cap": F.col("source_size") * cap, "total": F.sum("source_size").over(every)})
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = rows.withColumns({"words_left": F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    level = left.withColumn("level", F.max(F.col("words_left") / F.col("weight_left")).over(every))
    return level.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))).select("skey", "source_size", "weight", "target")


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] = ()) -> DataFrame:
    """The rows in the order of their sources' streams, numbered and stored: row, part, doc_id, source, skey, size.

    ``keep`` names columns to carry along as the struct ``own``; without it only narrow rows are sorted.
    """
    source = F.col(source_col).cast("string")
    own = [F.struct(*keep).alias("own")] if keep else []
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("skey"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("place"), *(own or [n_words(text).alias("size")]))
    if not keep:  # words are counted once, not again for the bounds of the ranges
        rows = stored(rows, "mix-sizes")
    order = ["skey", "doc_id", "tie", "place"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "place")
    if keep:
        rows = rows.withColumn("size", n_words(F.col("own")[text_col]))
    return stored(rows.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "mix-rows")


def located(rows: DataFrame) -> DataFrame:
    """Each dealt row with the place of its first word in its source's stream: row, doc_id, source, skey, size, start."""
    parts = rows.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("skey", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("skey", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    narrow = rows.select("row", "doc_id", "source", "skey", "part", "size").withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return narrow.join(parts, ["skey", "part"]).select("row", "doc_id", "source", "skey", "size", (F.col("part_start") + F.col("inside")).alias("start"))


def plan(places: DataFrame, block: int = BLOCK, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per source: sizes, target, blocks, whole epochs, words of the last epoch, numbers of slots and of all shards."""
    sizes = places.groupBy("skey").agg(F.sum("size").alias("source_size"))
    rows = source_targets(sizes, cap, weights).withColumn("take", F.floor("target"))
    size = F.greatest("source_size", F.lit(1))
    rows = rows.withColumns({"n_full": F.expr(f"source_size div {block}"), "n_blocks": F.ceil(F.col("source_size") / block), "whole": F.expr("take div greatest(source_size, 1)"), "rest": F.pmod(F.col("take"), size)})
    n_shards = F.greatest(F.ceil(F.sum("take").over(Window.partitionBy()) / shard_words), F.lit(1))
    return rows.withColumns({"slots": F.col("whole") * F.col("n_blocks") + F.ceil(F.col("rest") / block), "n_shards": n_shards})


def slots(plans: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The drawn mix: (skey, slot, shard, epoch, block, words) of every slot."""
    used = plans.where("slots > 0")
    n_tasks = max(1, -(-(used.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS))
    runs = used.select("skey", "slots", "n_shards", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {RUN}"))).alias("run"))
    runs = runs.repartition(n_tasks, "skey", "run")
    drawn = runs.select("skey", "n_shards", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("run") * RUN + RUN, "slots") - 1)).alias("j"))
    counts = drawn.groupBy("skey", F.pmod(F.xxhash64(F.lit(seed), "skey", "j"), F.col("n_shards")).alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = first.select("skey", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"), "first", "n").repartition(n_tasks, "skey", "shard", "run")
    numbered = pieces.select("skey", "shard", F.explode(F.sequence(F.col("first") + F.col("run") * RUN, F.col("first") + F.least(F.col("run") * RUN + RUN, "n") - 1)).alias("slot"))
    rows = numbered.join(used, "skey").withColumns({"epoch": F.expr("slot div n_blocks"), "place": F.pmod("slot", "n_blocks")})
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "skey", "epoch"))
    chosen = F.when(F.col("place") < F.col("n_full"), permuted(F.col("place"), F.greatest("n_full", F.lit(1).cast("long")), F.col("key"))).otherwise(F.col("n_full"))
    length = F.when(F.col("place") < F.col("n_full"), F.lit(block)).otherwise(F.col("source_size") - F.col("n_full") * block)
    cut = F.when(F.col("epoch") == F.col("whole"), F.least(length, F.col("rest") - F.col("place") * block)).otherwise(length)
    return rows.select("skey", "slot", "shard", "epoch", chosen.alias("block"), cut.cast("long").alias("words"))


def taken_spans(places: DataFrame, drawn: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, shard, slot, epoch, first, last): words first..last-1 of a document that a slot takes."""
    held = places.where("size > 0").select("row", "skey", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    met = held.join(drawn, ["skey", "block"])
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0).cast("long"))
    last = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    return met.select("row", "shard", "slot", "epoch", first.alias("first"), last.alias("last")).where("last > first")


class Mix(NamedTuple):
    """rows: dealt rows; places: their place in the streams; plans: one row per source; spans: the words that are taken."""

    rows: DataFrame
    places: DataFrame
    plans: DataFrame
    spans: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, shard_words: int = SHARD_WORDS, seed: int = SEED, keep: list[str] = ()) -> Mix:
    rows = dealt(docs, id_col, text_col, source_col, keep)
    places = stored(located(rows), "mix-places")
    plans = stored(plan(places, block, cap, weights, shard_words), "mix-plans")
    return Mix(rows, places, plans, taken_spans(places, slots(plans, block, seed), block))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    made = mix(docs, **options)
    taken = made.spans.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    rows = made.places.join(made.plans.select("skey", "source_size", "target"), "skey").join(taken, "row", "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str], text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: a row for each document and epoch that takes words of it, at most CAP per document.

    A document that an epoch takes whole keeps its text; otherwise its text is the words taken, in order, with
    blanks between. Documents of which nothing is taken go.
    """
    made = mix(docs, text_col=text_col, keep=columns, **options)
    epochs = made.spans.groupBy("row", "epoch").agg(F.sum(F.col("last") - F.col("first")).alias("n"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts"))
    rows = made.rows.select("row", "size", "own").join(epochs, "row")
    text = F.col("own")[text_col]
    every = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    cut = lambda words: F.array_join(F.flatten(F.transform("cuts", lambda s: F.slice(words, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), " ")
    taken = F.element_at(F.transform(F.array(every), cut), 1)  # a lambda's variable, so that the words are found once and not for each cut
    text = F.when(F.col("n") == F.col("size"), text).otherwise(taken)
    return rows.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in columns])
