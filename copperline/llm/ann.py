"""Nearest neighbours by inner product through shifted space-filling curves (operator 9).

Vectors get one more component, sqrt(M**2 - |x|**2) with M the largest norm, and queries are scaled to norm M, so
that the largest inner product is the least distance. Up to ``ORDERINGS`` different projections, each with a random
shift, map them to cells of a grid; the Hilbert curve through the grid orders them. Spark range-partitions and
sorts each ordering; tasks pack it into blocks of ``BLOCK`` vectors, with the queries where they fall. A query
searches the blocks up to ``reach`` away from its own in each ordering; candidates are scored on the original
vectors in double precision, and the best of all windows merge.

How many orderings are searched, and how far, is measured and not guessed: ``SAMPLE_QUERIES`` queries are also
compared with every row, and of all numbers of orderings, each with the least reach at which ``RECALL`` of the true
neighbours are met, the one with the fewest blocks for a query is taken. Vectors with structure need a few blocks.
Vectors without any (isotropic noise) have no ordering that keeps neighbours together. Where the windows would hold
the table or more, one ordering is indexed and its window is the whole table: an exact scan, in blocks, with recall 1.
A first estimate, by the sampled rows' places, spares the other orderings then.

Search: consecutive blocks make segments; a segment is one task's work, which holds its vectors and streams the
queries whose windows reach it, a block of them at a time. A query is sent once to a segment and not to each block.

Bounds: the projections are fitted on ``SAMPLE_ROWS`` rows; the driver sees these, the sampled queries with
their neighbours, and the reach. Every row is indexed. A task holds one segment, ``SEGMENT_BYTES`` at most, and a
block of queries.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without id, nor vectors of another length than the table's commonest (the shorter on ties). Rows that
share an id count once, with the smallest vector. Ties go to the smaller id. A query with fewer candidates
returns all. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperline.llm.common import stored

ORDERINGS = 4
DIMS, BITS = 6, 10
BLOCK = 512
SAMPLE_ROWS = 4096
SAMPLE_QUERIES = 64
RECALL = 0.96
#: Bytes of a segment's vectors.
SEGMENT_BYTES = 32 << 20
SEED = 20260101


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells [n, dims], integers under 2**bits (Skilling's transform)."""
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> bit) & 1)
    return key


class Curves:
    """The projections: of lifted vectors to cells, one grid per ordering."""

    def __init__(self, sample: np.ndarray, norm: float, orderings: int = ORDERINGS, dims: int = DIMS, bits: int = BITS, seed: int = SEED, scale: float = 1.0):
        """``scale``, a power of two, comes before everything else; ``norm`` is the largest of scaled vectors."""
        self.norm, self.bits, self.scale = norm, bits, scale
        lifted = self.lift(sample)
        self.mean = lifted.mean(0)
        _, spread, axes = np.linalg.svd(lifted - self.mean, full_matrices=False)
        dims = min(dims, len(axes))
        rng = np.random.default_rng(seed)
        self.maps, self.lows, self.steps = [], [], []
        for _ in range(orderings):  # directions that lean to the axes of largest spread
            turn, _ = np.linalg.qr(rng.standard_normal((len(axes), dims)) * (spread / max(spread.max(), 1e-30))[:, None] + 1e-9 * rng.standard_normal((len(axes), dims)))
            self.maps.append(axes.T @ turn)
            z = (lifted - self.mean) @ self.maps[-1]
            low, high = z.min(0), z.max(0)
            step = np.maximum(high - low, 1e-12) * 1.25 / (1 << bits)
            self.lows.append(low - rng.random(dims) * 0.2 * np.maximum(high - low, 1e-12))  # the shift
            self.steps.append(step)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]], 1)

    def lift_queries(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale
        size = np.sqrt((x * x).sum(1))[:, None]
        return np.concatenate([x * (self.norm / np.maximum(size, 1e-300)), np.zeros((len(x), 1))], 1)

    def keys(self, lifted: np.ndarray) -> list[np.ndarray]:
        """The key of each row in each ordering."""
        out = []
        for turn, low, step in zip(self.maps, self.lows, self.steps, strict=True):
            cells = np.clip(((lifted - self.mean) @ turn - low) / step, 0, (1 << self.bits) - 1)
            out.append(hilbert_keys(cells.astype(np.int64), self.bits))
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k best of each query, its own row left out; equal scores in the order of ids."""
    n = len(ids)
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ vectors.T
        # However it is summed, a product of these norms is off by less than this; beyond doubles nothing is left out.
        off = 4 * np.finfo(float).eps * vectors.shape[1] * np.abs(queries).max(1) * vectors.shape[1] * np.abs(vectors).max(initial=0)
    least = np.partition(rough, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else np.full(len(queries), -np.inf)  # k + 1: its own row may be among them
    bound = np.where(np.isfinite(least) & np.isfinite(off), least - off, -np.inf)
    keep = ~(rough < bound[:, None])
    for q, row in zip(range(len(queries)), keep, strict=True):
        at = np.flatnonzero(row)
        at = at[ids[at] != query_ids[q]]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = (vectors[at] * queries[q]).sum(1)  # one order of summation, so that equal vectors score alike
        best = np.lexsort((ids[at], -scores))[:k]
        yield ids[at][best], scores[best]


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    vec = F.col("vec")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec")).where("vec_id IS NOT NULL AND size(vec) > 0")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.forall(vec, sound) & F.exists(vec, lambda x: x != 0))
    width = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").first()
    rows = rows.where(F.size("vec") == (width.w if width else 0))
    twice = rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")  # narrow rows; vectors of other ids stay where they are
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(one)


_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(found: dict[int, tuple[np.ndarray, np.ndarray]], q: int, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    if q in found:
        ids, scores = np.concatenate([found[q][0], ids]), np.concatenate([found[q][1], scores])
        ids, first = np.unique(ids, return_index=True)
        scores = scores[first]
    order = np.lexsort((ids, -scores))[:k]
    found[q] = ids[order], scores[order]


def _table(found: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return _finds(list(found), list(found.values()))


def _finds(queries: list[int], best: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    lens = [len(ids) for ids, _ in best]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(queries, np.int64), lens)), pa.array(np.concatenate([ids for ids, _ in best])), pa.array(np.concatenate([scores for _, scores in best]))], schema=_TOP)


def brute_force(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, vec_id, score): of each partition the k best of each given query. For measuring."""
    ids, vectors = np.array([q[0] for q in queries], np.int64), np.array([q[1] for q in queries], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            own = batch.column(0).to_numpy()
            for q, (best, scores) in zip(ids.tolist(), top(vectors, ids, matrix(batch.column(1), vectors.shape[1]), own, k), strict=True):
                _best(found, q, best, scores, k)
        if found:
            yield _table(found)

    return rows.select("vec_id", "vec").mapInArrow(scan, "query_id long, vec_id long, score double")


_BLOCK_DDL = "ordering int, part int, seq int, n int, ids binary, vectors binary, n_queries int, query_ids binary, query_vectors binary"


def index(rows: DataFrame, curves: Curves, width: int, every: int, block: int) -> DataFrame:
    """Blocks of each ordering, numbered along the curve, stored: ordering, block, ids, vectors, and the queries within."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), width)
            ask = np.flatnonzero(ids % every == 0)
            for lifted, chosen, kind in ((curves.lift(x), np.arange(len(ids)), 0), (curves.lift_queries(x[ask]), ask, 1)):
                for ordering, keys in enumerate(curves.keys(lifted) if len(chosen) else ()):
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ordering, np.int32)), pa.array(keys), pa.array(np.full(n, kind, np.int32)), batch.column(0).take(pa.array(chosen)), batch.column(1).take(pa.array(chosen))], names=["ordering", "key", "kind", "vec_id", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, at = TaskContext.get().partitionId(), 0, None
        held: list[tuple[list, list]] = [([], []), ([], [])]

        def full() -> pa.RecordBatch:
            sides = [(np.array(i, np.int64), np.array(v, np.float64)) for i, v in held]
            row = [at, part, seq, len(sides[0][0]), sides[0][0].tobytes(), sides[0][1].tobytes(), len(sides[1][0]), sides[1][0].tobytes(), sides[1][1].tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK_DDL.split(", ")])

        for batch in batches:
            vectors = matrix(batch.column(4), width)
            for k, (ordering, kind, vec_id) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)):
                if at != ordering or len(held[0][0]) >= block or len(held[1][0]) >= block:
                    if held[0][0] or held[1][0]:
                        yield full()
                        seq += 1
                    at, held = ordering, [([], []), ([], [])]
                held[kind][0].append(vec_id)
                held[kind][1].append(vectors[k])
        if held[0][0] or held[1][0]:
            yield full()

    placed = rows.mapInArrow(place, "ordering int, key long, kind int, vec_id long, vec array<double>")
    dealt = placed.repartitionByRange("ordering", "key", "vec_id").sortWithinPartitions("ordering", "key", "vec_id")
    blocks = stored(dealt.mapInArrow(pack, _BLOCK_DDL), "ann-blocks")
    order = Window.partitionBy("ordering").orderBy("part", "seq")  # one narrow row a block
    numbers = blocks.select("ordering", "part", "seq").withColumn("block", F.row_number().over(order))
    return blocks.join(numbers, ["ordering", "part", "seq"])


class Windows(NamedTuple):
    """How a search goes: so many orderings, so many blocks to either side, of so many in an ordering."""

    orderings: int
    reach: int
    n_blocks: int

    @property
    def share(self) -> float:
        """Blocks that a query meets at most, as a share of the table's."""
        return self.orderings * min(2 * self.reach + 1, self.n_blocks) / max(self.n_blocks, 1)


def cheapest(away: np.ndarray, recall: float, n_blocks: int) -> Windows:
    """The windows with the fewest blocks, from the distance in blocks of each (query, neighbour) pair in each ordering.

    If they would hold the whole table, one ordering is searched from end to end.
    """
    plans = [Windows(1, n_blocks, n_blocks)]
    for m in range(1, away.shape[1] + 1):
        near = np.sort(away[:, :m].min(1))
        plans.append(Windows(m, int(near[min(len(near) - 1, int(np.ceil(recall * len(near))) - 1)]) if len(near) else 0, n_blocks))
    return min(plans, key=lambda p: p.share)


def estimated(curves: Curves, sample: np.ndarray, queries: np.ndarray, neighbours: np.ndarray, recall: float, n_blocks: int) -> Windows:
    """The cheapest windows, by the places of (query, neighbour) pairs among the sampled rows."""
    places = []
    for own, asked, met in zip(*(curves.keys(x) for x in (curves.lift(sample), curves.lift_queries(queries), curves.lift(neighbours))), strict=True):
        own = np.sort(own)
        places.append(np.abs(np.searchsorted(own, asked) - np.searchsorted(own, met)) * n_blocks // len(own))
    return cheapest(np.stack(places, 1), recall, n_blocks)


def measured(blocks: DataFrame, truth: list[tuple[int, int]], recall: float, n_blocks: int) -> Windows:
    """The cheapest windows, by the blocks where the (query, neighbour) pairs stand."""
    wanted, asked = {v for _, v in truth}, {q for q, _ in truth}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ordering, block, ids, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(ordering, block, i, 0) for i in np.frombuffer(ids, np.int64).tolist() if i in wanted]
                rows += [(ordering, block, i, 1) for i in np.frombuffer(queries, np.int64).tolist() if i in asked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["ordering", "block", "vec_id", "kind"])

    places: dict[tuple[int, int], dict[int, int]] = {}
    for r in blocks.select("ordering", F.col("block").cast("long"), "ids", "query_ids").mapInArrow(find, "ordering long, block long, vec_id long, kind long").collect():
        places.setdefault((r.kind, r.vec_id), {})[r.ordering] = r.block
    away = [[abs(b - places[0, v][o]) for o, b in sorted(places[1, q].items())] for q, v in truth]
    return cheapest(np.array(away, np.int64), recall, n_blocks)


def search(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, recall: float = RECALL, orderings: int = ORDERINGS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    spark = table.sparkSession
    rows = stored(usable(table, id_col, vector_col), "ann-rows")
    blocks, how, width = indexed(rows, k, every, block, recall, orderings)
    if blocks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_cores = max(1, spark.sparkContext.defaultParallelism)
    size = int(np.clip(how.n_blocks * how.orderings // (4 * n_cores), 1, max(1, SEGMENT_BYTES // (8 * width * block))))  # blocks of a segment
    reach = how.reach

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        place = ids = vectors = None
        for batch in batches:
            for ordering, segment, kind, number, own, data in zip(*batch.columns, strict=True):
                number, these, x = number.as_py(), np.frombuffer(own.as_py(), np.int64), np.frombuffer(data.as_py(), np.float64).reshape(-1, width)
                if at != (ordering.as_py(), segment.as_py()):
                    at, held, place = (ordering.as_py(), segment.as_py()), [], None
                if kind.as_py() == 0:  # a segment's blocks come before its queries
                    held.append((np.full(len(these), number), these, x))
                    continue
                if held:
                    place, ids, vectors = (np.concatenate(p) for p in zip(*held, strict=True))
                    held = []
                if place is not None:
                    a, b = np.searchsorted(place, number - reach), np.searchsorted(place, number + reach, "right")
                    if b > a:
                        yield _finds(these.tolist(), list(top(x, these, vectors[a:b], ids[a:b], k)))

    lists = blocks.where("n > 0").select("ordering", F.expr(f"block div {size}").alias("segment"), F.lit(0).alias("kind"), "block", "ids", "vectors")
    last = how.n_blocks // size
    low, high = F.greatest(F.expr(f"(block - {reach}) div {size}"), F.lit(0).cast("long")), F.least(F.expr(f"(block + {reach}) div {size}"), F.lit(last).cast("long"))
    asking = blocks.where("n_queries > 0").select("ordering", F.explode(F.sequence(low, high)).alias("segment"), F.lit(1).alias("kind"), "block", F.col("query_ids").alias("ids"), F.col("query_vectors").alias("vectors"))
    # Small rows and much work: without a number, adaptive execution would join segments into few tasks.
    n_tasks = min(how.orderings * (last + 1), 1 << 15)
    dealt = lists.unionByName(asking).repartition(n_tasks, "ordering", "segment").sortWithinPartitions("ordering", "segment", "kind", "block")
    found = dealt.mapInArrow(scan, "query_id long, vec_id long, score double")
    merged = found.distinct() if how.orderings > 1 else found
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def indexed(rows: DataFrame, k: int, every: int, block: int, recall: float, orderings: int = ORDERINGS) -> tuple[DataFrame | None, Windows | None, int]:
    """(blocks of the orderings that are searched, how, width of the vectors); without rows, None."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    if not sample:
        return None, None, 0
    width = len(sample[0].vec)
    vectors = np.array([r.vec for r in sample])
    largest = rows.agg(F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))).first()[0]
    scale = 2.0 ** -min(max(int(np.frexp(largest)[1]), -1000), 1000)  # squares of scaled vectors are doubles
    about = rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x * scale) * (x * scale)))).alias("norm"), F.count("*").alias("n")).first()
    asked = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in brute_force(rows, [(r.vec_id, r.vec) for r in asked], k).collect() if asked else ():
        _best(found, r.query_id, np.array([r.vec_id]), np.array([r.score]), k)
    truth = [(q, v) for q, (ids, _) in found.items() for v in ids.tolist()]

    curves = Curves(vectors, about.norm, orderings, scale=scale)
    n_blocks = -(-about.n // block)
    if truth:
        met = {r.vec_id: r.vec for r in rows.where(F.col("vec_id").isin(sorted({v for _, v in truth}))).collect()}  # SAMPLE_QUERIES times k at most
        own = {r.vec_id: r.vec for r in asked}
        guess = estimated(curves, vectors, np.array([own[q] for q, _ in truth]), np.array([met[v] for _, v in truth]), recall, n_blocks)
        if guess.share >= 1:
            curves = Curves(vectors, about.norm, 1, scale=scale)
    blocks = stored(index(rows, curves, width, every, block), "ann-index")
    n_blocks = blocks.agg(F.max("block")).first()[0] + 1
    if truth and len(curves.maps) == 1 < orderings:
        return blocks, Windows(1, n_blocks, n_blocks), width
    how = measured(blocks, truth, recall, n_blocks) if truth else Windows(1, 0, n_blocks)
    return blocks.where(F.col("ordering") < how.orderings), how, width
