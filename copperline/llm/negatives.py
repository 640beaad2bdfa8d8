"""Hard negatives by bit-sliced integer products (operator 13).

Components become integers, floor(``SCALE`` * x). The rows are stored as bit planes: plane k of a segment holds bit k of
every component, offset to be positive. A product of a query with a row is the sum over planes, the most
significant first; after each plane the bits that are left bound the product from both sides. Rows whose interval can't
reach a search's best any more, or lies outside its window, are dropped, and the next planes meet only the rest; after the
last plane the intervals are exact scores.

1. Rows are dealt by the hash of their id to segments of bounded size, sorted by label within and packed. Labels are
   slices of each segment, so a label of any size is spread over all tasks.
2. Each anchor asks every segment for its ``positives`` best rows of its own label; the segments' bests merge.
3. Each anchor asks again, once for each positive, for the ``negatives`` best rows of other labels whose score lies
   between ``low`` and ``high`` per cent of the positive's; these merge too.

A segment's blocks come before the queries, which stream past them a block at a time. The anchors are the stated
query set; every one of them is held against all rows, in blocks. A task holds a segment's planes and the matrix of one
block of queries with ``CHUNK`` rows. Nothing but three numbers of the table goes through the driver.

Defined results: rows with a null id, label or vector, an empty vector, a null or non-finite component, or a vector of
another length than the table's commonest (the shorter on ties) take no part. Rows that share an id count once, with
the smallest vector, then label. Equal scores: the smaller id first. An anchor without another row of its label has no
positive, a positive without a row in its window no result. Zero vectors take part, and so does a negative score, whose
window is empty. An empty table gives no rows. Components so large that scores would not fit a long raise
ArithmeticError. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperline.llm.common import stored

#: Components are multiplied by this before they are rounded down.
SCALE = 256
#: Rows of a segment at most, rows of a stored block, queries of a block, rows that are held against a block at once.
SEGMENT_ROWS, BLOCK_ROWS, QUERIES, CHUNK = 1 << 17, 4096, 128, 4096
#: Rows of a segment at least, before cores are given more of them.
LEAST_ROWS = 256
#: From this share of pairs that are left on, planes meet pairs and not the whole matrix.
SPARSE = 0.1
_FAR = 1 << 62


class Sliced:
    """Rows as packed bit planes: planes[k, row] are the bits k of the row's components plus ``offset``."""

    def __init__(self, planes: np.ndarray, offset: int, width: int):
        self.planes, self.offset, self.width = planes, offset, width

    @classmethod
    def of(cls, vectors: np.ndarray, offset: int, n_planes: int) -> Sliced:
        raised = (vectors + offset).astype(np.uint64)
        return cls(np.stack([np.packbits(((raised >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), axis=1) for k in range(n_planes)]), offset, vectors.shape[1])

    def bits(self, k: int, rows) -> np.ndarray:
        return np.unpackbits(self.planes[k, rows], axis=1, count=self.width)


class Searches(NamedTuple):
    """Queries, and what each asks: the best rows with a score of ``low`` to ``high``."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    query: np.ndarray  # of each search, its query's place
    low: np.ndarray
    high: np.ndarray
    tag: np.ndarray


def best_of(search: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each search, by falling score and then id."""
    order = np.lexsort((ids, -scores, search))
    own = search[order]
    first = np.searchsorted(own, own, "left")
    return order[np.arange(len(order)) - first < k]


def kth_best(search: np.ndarray, scores: np.ndarray, k: int, n: int) -> np.ndarray:
    """The k-th best score of each of n searches; far below all where there are fewer."""
    least = np.full(n, -_FAR)
    order = np.lexsort((-scores, search))
    own = search[order]
    last = np.searchsorted(own, np.arange(n), "left") + k - 1
    enough = np.flatnonzero(np.searchsorted(own, np.arange(n), "right") > last)
    least[enough] = scores[order[last[enough]]]
    return least


def scan(asked: Searches, queries: np.ndarray, rows: Sliced, fits: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search, row, exact score) among which are the k best of each search of the ``queries``.

    ``fits``: which (query, row) pairs may meet. ``floor``: of each search, a score below which nothing is wanted.
    """
    vectors = asked.vectors[queries]
    exact = np.float32 if int(np.abs(vectors).sum(1).max(initial=0)) < 1 << 24 else np.float64
    factors = vectors.astype(exact)
    fall, rise = np.minimum(vectors, 0).sum(1), np.maximum(vectors, 0).sum(1)
    own = np.flatnonzero(np.isin(asked.query, queries))  # the searches, query by query
    of = np.searchsorted(queries, asked.query[own])
    low, high = np.maximum(asked.low, floor)[own], asked.high[own]
    widest = np.full(len(queries), _FAR), np.full(len(queries), -_FAR)
    np.minimum.at(widest[0], of, low)
    np.maximum.at(widest[1], of, high)
    open_top = len(own) == len(queries) and bool((high >= _FAR).all())  # one search a query, of the best of all

    sums = np.repeat(-rows.offset * vectors.sum(1)[:, None], fits.shape[1], 1)
    alive, pair = fits.copy(), None
    for plane in range(len(rows.planes) - 1, -1, -1):
        rest = (1 << plane) - 1
        if pair is None:
            sums += (factors @ rows.bits(plane, slice(None)).astype(exact).T).astype(np.int64) << plane
            spread = sums.max(1) - sums.min(1) if sums.size else np.zeros(len(queries), np.int64)
            outside = (sums.min(1, initial=_FAR) + rest * rise < widest[0]) | (sums.max(1, initial=-_FAR) + rest * fall > widest[1])
            if plane and not (outside | (spread > rest * (rise - fall))).any():
                continue  # no interval is narrow enough to leave anything out
            least = widest[0]
            if open_top and fits.shape[1] > k:
                sure = np.where(fits, sums + rest * fall[:, None], -_FAR)
                least = np.maximum(least, np.partition(sure, fits.shape[1] - k, axis=1)[:, fits.shape[1] - k])
            alive &= (sums + rest * rise[:, None] >= least[:, None]) & (sums + rest * fall[:, None] <= widest[1][:, None])
            if plane and alive.sum() > SPARSE * alive.size:
                continue
            q, row = np.nonzero(alive)
            total = sums[q, row]
            at = np.searchsorted(of, q, "left")  # each pair with each search of its query
            times = np.searchsorted(of, q, "right") - at
            pair = np.repeat(np.arange(len(q)), times)
            search = np.repeat(at - (np.cumsum(times) - times), times) + np.arange(len(pair))
        else:
            for i in range(0, len(q), 1 << 14):
                part = slice(i, i + (1 << 14))
                total[part] += (rows.bits(plane, row[part]) * vectors[q[part]]).sum(1) << plane
        lo, hi = (total + rest * fall[q])[pair], (total + rest * rise[q])[pair]
        wanted = (hi >= low[search]) & (lo <= high[search])
        sure = wanted & (lo >= low[search]) & (hi <= high[search])
        wanted &= hi >= kth_best(search[sure], lo[sure], k, len(own))[search]
        left, again = np.unique(pair[wanted], return_inverse=True)
        q, row, total, pair, search = q[left], row[left], total[left], again, search[wanted]
    return own[search], row[pair], total[pair]


def usable(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec) of the rows that take part, with components as doubles already rounded down."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    width = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "w").first()
    rows = rows.where(F.size("vec") == (width.w if width else 0))
    twice = rows.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").select("vec_id")  # narrow rows
    one = rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("row")).select("vec_id", "row.label", "row.vec")
    return rows.join(twice, "vec_id", "left_anti").unionByName(one)


def rounded(rows: DataFrame) -> DataFrame:
    """``vec`` as longs, in units of 1 / ``SCALE``."""
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * float(SCALE)).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _packed(columns: dict[str, np.ndarray | int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) if isinstance(c, np.ndarray) else pa.array([c], pa.int64()) for c in columns.values()], names=list(columns))


_BLOCK_DDL = "segment long, ids binary, labels binary, planes binary"
_QUERY_DDL = "ids binary, labels binary, vectors binary, query binary, low binary, high binary, tag binary"


def sliced(rows: DataFrame, n_segments: int, offset: int, n_planes: int, width: int) -> DataFrame:
    """Blocks of bit planes, by segment, rows sorted by label and id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(segment)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(segment)], strict=True):
                for a in range(i, j, BLOCK_ROWS):
                    b = min(j, a + BLOCK_ROWS)
                    own = Sliced.of(matrix(batch.column(3).slice(a, b - a), width), offset, n_planes)
                    yield _packed({"segment": int(segment[a]), "ids": batch.column(1).slice(a, b - a).to_numpy(), "labels": batch.column(2).slice(a, b - a).to_numpy(), "planes": own.planes})

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_segments)).alias("segment"), "vec_id", "label", "vec")
    return dealt.repartition(min(n_segments, 1 << 15), "segment").sortWithinPartitions("segment", "label", "vec_id").mapInArrow(pack, _BLOCK_DDL)


def asking(queries: DataFrame, width: int) -> DataFrame:
    """Blocks of queries (query_id, label, vec, asks: array of low, high, tag)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, QUERIES) for b in batches for k in range(0, b.num_rows, QUERIES)):
            asks = batch.column(3)
            each = asks.flatten()
            query = np.repeat(np.arange(batch.num_rows), np.diff(asks.offsets.to_numpy()))
            yield _packed({"ids": batch.column(0).to_numpy(), "labels": batch.column(1).to_numpy(), "vectors": matrix(batch.column(2), width), "query": query} | {n: each.field(n).to_numpy() for n in ("low", "high", "tag")})

    return queries.select("query_id", "label", "vec", "asks").mapInArrow(pack, _QUERY_DDL)


def answered(blocks: DataFrame, queries: DataFrame, n_segments: int, offset: int, n_planes: int, width: int, k: int, same: bool) -> DataFrame:
    """(query_id, tag, vec_id, score): of each segment the k best rows of each search, with the query's label or any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, segment = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                number, kind, *data = (batch.column(c)[row].as_py() for c in range(batch.num_columns))
                if number != at:
                    at, held, segment = number, [], None
                if kind == 0:  # a segment's blocks come before its queries
                    ids, labels = np.frombuffer(data[0], np.int64), np.frombuffer(data[1], np.int32)
                    held.append((ids, labels, np.frombuffer(data[2], np.uint8).reshape(n_planes, len(ids), -1)))
                    continue
                if held:
                    order = np.argsort(np.concatenate([h[1] for h in held]), kind="stable")
                    segment = np.concatenate([h[0] for h in held])[order], np.concatenate([h[1] for h in held])[order], np.concatenate([h[2] for h in held], 1)[:, order]
                    held = []
                if segment is not None:
                    kinds = [np.int64, np.int32, np.int64, np.int64, np.int64, np.int64, np.int64]
                    asked = [np.frombuffer(d, t) for d, t in zip(data, kinds, strict=True)]
                    asked[2] = asked[2].reshape(-1, width)
                    yield from found(Searches(*asked), *segment)

    def found(asked: Searches, ids: np.ndarray, labels: np.ndarray, planes: np.ndarray) -> Iterator[pa.RecordBatch]:
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor = np.full(len(asked.low), -_FAR)
        if same:  # labels are slices
            edges = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]).tolist()
            places = [(a, min(a + CHUNK, e)) for s, e in zip(edges[:-1], edges[1:], strict=True) for a in range(s, e, CHUNK)]
        else:
            places = [(a, min(a + CHUNK, len(ids))) for a in range(0, len(ids), CHUNK)]
        for a, b in places:
            queries = np.flatnonzero(asked.labels == labels[a]) if same else np.arange(len(asked.ids))
            if not len(queries):
                continue
            fits = asked.ids[queries][:, None] != ids[a:b] if same else asked.labels[:, None] != labels[a:b]
            search, row, score = scan(asked, queries, Sliced(planes[:, a:b], offset, width), fits, floor, k)
            best = tuple(np.concatenate(p) for p in zip(best, (search, ids[a:b][row], score), strict=True))
            keep = best_of(best[0], best[2], best[1], k)
            best = tuple(p[keep] for p in best)
            floor = np.maximum(floor, kth_best(best[0], best[2], k, len(floor)))
        if len(best[0]):
            columns = asked.ids[asked.query[best[0]]], asked.tag[best[0]], best[1], best[2]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "tag", "vec_id", "score"])

    nothing = [F.lit(None).cast("binary").alias(n) for n in ("d", "e", "f", "g")]
    lists = blocks.select("segment", F.lit(0).alias("kind"), F.col("ids").alias("a"), F.col("labels").alias("b"), F.col("planes").alias("c"), *nothing)
    names = [c.split()[0] for c in _QUERY_DDL.split(", ")]
    every = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_segments - 1).cast("long"))).alias("segment"), F.lit(1).alias("kind"), *[F.col(n).alias(x) for n, x in zip(names, "abcdefg", strict=True)])
    dealt = lists.union(every).repartition(min(n_segments, 1 << 15), "segment").sortWithinPartitions("segment", "kind")
    return dealt.mapInArrow(run, "query_id long, tag long, vec_id long, score long")


def _ranked(found: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: ids divisible by ``every``."""
    spark = table.sparkSession
    rows = stored(usable(table, id_col, vector_col, label_col), "mine-rows")
    about = rows.agg(F.count("*").alias("n"), F.max(F.array_max("vec")).alias("top"), F.min(F.array_min("vec")).alias("bottom"), F.max(F.size("vec")).alias("width")).first()
    if not about.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bottom, top = (int(np.floor(x * SCALE)) if abs(x * SCALE) < 1 << 40 else None for x in (about.bottom, about.top))
    if bottom is None or top is None or about.width * max(abs(bottom), abs(top), 1) ** 2 >= 1 << 60:
        raise ArithmeticError("scores of components of this size do not fit a long")
    n_planes = max(1, (top - bottom).bit_length())
    cores = max(1, spark.sparkContext.defaultParallelism)
    n_segments = max(-(-about.n // SEGMENT_ROWS), min(4 * cores, -(-about.n // LEAST_ROWS)))
    shape = n_segments, -bottom, n_planes, about.width
    blocks = stored(sliced(rounded(rows), *shape), "mine-planes")

    anchors = rounded(rows.where(F.col("vec_id") % every == 0)).withColumnRenamed("vec_id", "query_id")
    ask = lambda a, b, tag: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"), tag.cast("long").alias("tag"))
    first = asking(anchors.withColumn("asks", F.array(ask(F.lit(-_FAR), F.lit(_FAR), F.lit(0)))), about.width)
    near = _ranked(answered(blocks, first, *shape, positives, same=True), ["query_id"], positives)
    near = stored(near.select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")

    share = lambda percent: F.expr(f"cast(positive_score as decimal(20, 0)) * {percent} / 100")
    floor, ceiling = F.ceil(share(low)), F.floor(share(high))
    windows = near.groupBy("query_id").agg(F.collect_list(ask(floor, ceiling, F.col("positive_id"))).alias("asks"))  # ``positives`` each
    second = asking(anchors.join(windows, "query_id"), about.width)
    found = _ranked(answered(blocks, second, *shape, negatives, same=False), ["query_id", "tag"], negatives)
    out = found.withColumnRenamed("tag", "positive_id").join(near, ["query_id", "positive_id"])
    return out.select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
