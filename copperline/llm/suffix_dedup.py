"""Repeated passages by sparse suffix arrays (operator 3).

Words are runs of non-white bytes, ASCII letters lower-cased. A passage counts if at least ``MIN_WORDS`` words in a
row occur in two documents or more.

1. Of every ``MIN_WORDS - GRAM + 1`` consecutive word n-grams of a document the one with the least hash is a
   minimiser. Its position depends on content alone, so each passage of MIN_WORDS words that two documents
   share has a minimiser at the same place in both: only these suffixes are retained (about one in twenty).
2. Minimisers whose n-gram occurs in one document only go. The others are suffixes with their context: the
   words that follow, up to MIN_WORDS, and those before, up to MIN_WORDS - GRAM, as 32-bit hashes.
3. Spark sorts the suffixes by n-gram and following words, range-partitioned over the whole key down to document and
   position. Each suffix is compared with its ``NEIGHBOURS`` neighbours on either side, to the right and to the
   left. A match of MIN_WORDS words or more marks its span in both documents. N-grams of up to NEIGHBOURS + 1
   suffixes go this way: each of their suffixes meets every other. The first and last suffixes of each partition are
   dealt by n-gram and compared again, so that an n-gram that a boundary cuts is whole.
4. In larger groups a partner may stand anywhere, as a match that needs words to the left is not adjacent in that
   order. Each such minimiser gives the windows of MIN_WORDS words whose minimiser it is, as 64-bit hashes. They go
   through the same sort, with no context, by hash, document and position, so that a passage in a third of all
   documents spans many partitions; a window that stands in two documents marks its span in all. Runs that meet the
   boundary of a partition are settled apart.
5. Spans of a document that touch become one. Longer passages hold a minimiser at least every MIN_WORDS words, so
   their spans join up.

Defined results: null or empty texts, or texts under MIN_WORDS words, have no spans. Rows that share an id are
one document. Rows with a null id take no part. An empty table gives no rows. Long texts are taken whole; their words
are hashed part by part. Extra columns are not looked at.
Repeats within one document alone are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperline.llm import bytesplit
from copperline.llm.common import stored

MIN_WORDS = 50
GRAM = 8
NEIGHBOURS = 8
#: Suffixes that are compared at once.
CHUNK = 8192


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    n = max(len(hashes) - k + 1, 0)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = bytesplit.mix(out + hashes[i : i + n] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return out


def owners(codes: np.ndarray, window: int) -> np.ndarray:
    """For each window of consecutive codes the position of its least code (the first, on ties)."""
    if len(codes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(codes, window)
    return np.concatenate([views[i : i + 65536].argmin(1) + np.arange(i, min(i + 65536, len(views))) for i in range(0, len(views), 65536)])


def minimisers(codes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least code (the first, on ties) of each window of consecutive codes."""
    return np.unique(owners(codes, window))


def windows(codes: np.ndarray, min_words: int, gram: int) -> np.ndarray:
    """Hash of each min_words consecutive words, from the hashes of their n-grams."""
    n = max(len(codes) - (min_words - gram), 0)
    out = np.full(n, np.uint64(min_words))
    for i in [*range(0, min_words - gram, gram), min_words - gram]:
        out = bytesplit.mix(out + codes[i : i + n] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return out


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")


def anchors(texts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(doc_id, pos, anchor): the minimisers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytesplit.text_buffer(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in bytesplit.spans(offsets):
                hashes, bounds = bytesplit.word_hashes(data, offsets[i : j + 1])
                docs, places, codes = [], [], []
                for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if b - a >= min_words:
                        own = grams(hashes[a:b], gram)
                        at = minimisers(own, min_words - gram + 1)
                        docs.append(np.full(len(at), ids[i + d]))
                        places.append(at)
                        codes.append(own[at].view(np.int64))
                if docs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, places, codes)], names=["doc_id", "pos", "anchor"])

    return texts.mapInArrow(run, "doc_id long, pos long, anchor long")


_SUFFIX_DDL = "anchor long, right binary, left binary, doc_id long, pos long"


def contexts(texts: DataFrame, kept: DataFrame, min_words: int, gram: int) -> DataFrame:
    """The suffixes of the kept (doc_id, pos, anchor, wide) with their context: anchor, right, left (outwards), doc_id, pos.

    Wide ones give their windows instead, with the window's hash as anchor, its first word as pos and empty contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytesplit.text_buffer(batch.column(1))
            for i, j in bytesplit.spans(offsets):
                hashes, bounds = bytesplit.word_hashes(data, offsets[i : j + 1])
                short = (hashes >> np.uint64(32)).astype(">u4")
                rows: list[tuple] = []
                for d in range(i, j):
                    a, b = int(bounds[d - i]), int(bounds[d - i + 1])
                    own, codes, doc = short[a:b], grams(hashes[a:b], gram).view(np.int64), batch.column(0)[d].as_py()
                    wide = []
                    for place in batch.column(2)[d].as_py():
                        pos = place["pos"]
                        if pos < len(codes) and codes[pos] == place["anchor"]:
                            if place["wide"]:
                                wide.append(pos)
                                continue
                            rows.append((place["anchor"], own[pos : pos + min_words].tobytes(), own[max(0, pos - min_words + gram) : pos][::-1].tobytes(), doc, pos))
                            if len(rows) >= CHUNK:
                                yield _suffixes(rows)
                                rows = []
                    if wide:
                        codes = codes.view(np.uint64)
                        at = np.flatnonzero(np.isin(owners(codes, min_words - gram + 1), wide))
                        found = windows(codes, min_words, gram)[at].view(np.int64)
                        for k in range(0, len(at), CHUNK):
                            yield _windows(found[k : k + CHUNK], np.full(len(at[k : k + CHUNK]), doc), at[k : k + CHUNK])
                if rows:
                    yield _suffixes(rows)

    places = kept.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "anchor", "wide")).alias("places"))
    return texts.join(places.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "places").mapInArrow(run, _SUFFIX_DDL)


_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _suffixes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=["anchor", "right", "left", "doc_id", "pos"])


def _windows(hashes: np.ndarray, docs: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    none = pa.array([b""] * len(first), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), none, none, pa.array(docs, pa.int64()), pa.array(first, pa.int64())], names=["anchor", "right", "left", "doc_id", "pos"])


def _words(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, padded to width, and lengths)."""
    lens = np.fromiter((len(x) // 4 for x in column), np.int64, len(column))
    flat = np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in column), np.uint32).reshape(-1, width)
    return flat, lens


def common(a: np.ndarray, b: np.ndarray, a_lens: np.ndarray, b_lens: np.ndarray) -> np.ndarray:
    """Leading words that each pair of rows has in common."""
    same = np.cumprod(a == b, axis=1).sum(1) if a.shape[1] else np.zeros(len(a), np.int64)
    return np.minimum(same, np.minimum(a_lens, b_lens))


def compare(rows: list[tuple], min_words: int, gram: int, reach: int = NEIGHBOURS) -> list[tuple[int, int, int]]:
    """Spans (doc_id, first, last) that neighbours among sorted suffix rows share; last is one past the end."""
    units: list[int] = []  # the first row of each run of one document and context
    unit_of = []
    for k, r in enumerate(rows):
        if not units or r[:4] != rows[units[-1]][:4]:
            units.append(k)
        unit_of.append(len(units) - 1)
    if len(units) < 2:
        return []
    anchor = np.array([rows[u][0] for u in units], np.int64)
    doc = np.array([rows[u][3] for u in units], np.int64)
    right, right_lens = _words([rows[u][1] for u in units], min_words)
    left, left_lens = _words([rows[u][2] for u in units], min_words - gram)
    marks: dict[int, set[tuple[int, int]]] = {}
    for s in range(1, min(reach, len(units) - 1) + 1):
        i = np.flatnonzero((anchor[:-s] == anchor[s:]) & (doc[:-s] != doc[s:]))
        if len(i):
            r = common(right[i], right[i + s], right_lens[i], right_lens[i + s])
            ahead = common(left[i], left[i + s], left_lens[i], left_lens[i + s])
            for k in np.flatnonzero((r >= gram) & (r + ahead >= min_words)).tolist():
                for u in (int(i[k]), int(i[k]) + s):
                    marks.setdefault(u, set()).add((int(ahead[k]), int(r[k])))
    return [(rows[k][3], rows[k][4] - ahead, rows[k][4] + r) for k, u in enumerate(unit_of) for ahead, r in marks.get(u, ())]


def _streamed(batches: Iterator[pa.RecordBatch], min_words: int, gram: int, edges: list | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Spans of a sorted stream, chunk by chunk, or none after a batch that fills no chunk; ``edges`` receives its first and last suffixes."""
    held: list[tuple] = []
    began = False
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) < CHUNK:
            yield []
            continue
        yield compare(held, min_words, gram)
        if edges is not None and not began:
            edges += _ends(held, first=True)
            began = True
        held = _ends(held, first=False)
    if held:
        yield compare(held, min_words, gram)
        if edges is not None:
            edges += [] if began else _ends(held, first=True)
            told = set(edges)
            edges += [r for r in _ends(held, first=False) if r not in told]


def _ends(rows: list[tuple], first: bool) -> list[tuple]:
    """All rows of the first or last NEIGHBOURS runs of one document and context."""
    picked: list[list[tuple]] = []
    for r in rows if first else reversed(rows):
        if picked and picked[-1][0][:4] == r[:4]:
            picked[-1].append(r)
        elif len(picked) == NEIGHBOURS:
            break
        else:
            picked.append([r])
    out = [r for run in picked for r in run]
    return out if first else out[::-1]


class Shared:
    """Of windows sorted by hash, document and position, batch by batch, the (document, position) of those that stand in two documents.

    ``edges`` holds rows of the first run of one hash, and ``held`` of the last, that tell what the runs' parts in
    other partitions need: all rows while only one document was met, else one of the first and one of the last.
    """

    def __init__(self) -> None:
        self.edges: np.ndarray | None = None
        self.held = np.zeros((0, 3), np.int64)

    def add(self, rows: np.ndarray) -> np.ndarray:
        rows = np.concatenate([self.held, rows])
        if not len(rows):
            return rows[:, 1:]
        begin = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        end = np.r_[begin[1:], len(rows)]
        many = rows[begin, 1] != rows[end - 1, 1]
        brief = lambda k: rows[[begin[k], end[k] - 1]] if many[k] else rows[begin[k] : end[k]]
        if len(begin) > 1 and self.edges is None:
            self.edges = brief(0)
        self.held = brief(-1)
        return rows[np.repeat(many, end - begin), 1:]

    def ends(self) -> np.ndarray:
        return self.held if self.edges is None else np.concatenate([self.edges, self.held])


def _table(batch: pa.RecordBatch) -> np.ndarray:
    """(anchor, doc_id, pos) of a batch of windows."""
    return np.stack([batch.column(c).to_numpy() for c in ("anchor", "doc_id", "pos")], axis=1)


_SPAN = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, last_word, n_words) of each repeated passage; last_word is one past its end."""
    texts = _ids(docs, id_col, text_col)
    found = stored(anchors(texts, min_words, gram), "suffix-anchors")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    shared = shared.select("anchor", (F.col("n") > NEIGHBOURS + 1).alias("wide"))
    shared = stored(shared, "suffix-shared")  # a plain exchange on either side of the join lets a hot anchor be split
    kept = found.join(shared, "anchor").select("doc_id", "pos", "anchor", "wide")
    suffixes = contexts(texts, kept, min_words, gram)
    order = ["anchor", "right", "left", "doc_id", "pos"]
    dealt = suffixes.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edges, seen = TaskContext.get().partitionId(), [], Shared()

        def marked(doc: pa.Array, first: pa.Array, last: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc, first, last, *(pa.nulls(len(doc), t) for t in (*_TYPES, pa.int32()))], names=names)

        def suffixes() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                window = pc.equal(pc.binary_length(batch.column(1)), 0)
                hits.append(seen.add(_table(batch.filter(window))))
                yield batch.filter(pc.invert(window))

        hits: list[np.ndarray] = []
        for spans in _streamed(suffixes(), min_words, gram, edges):
            while hits:
                at = hits.pop()
                yield marked(pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(at[:, 1] + min_words))
            if spans:
                yield marked(*(pa.array(x, pa.int64()) for x in zip(*spans, strict=True)))
        edges += [(h, b"", b"", d, p) for h, d, p in seen.ends().tolist()]
        if edges:
            columns = [pa.array(x, t) for x, t in zip(zip(*edges, strict=True), _TYPES, strict=True)]
            blank = [pa.nulls(len(edges), pa.int64()) for _ in range(3)]
            yield pa.RecordBatch.from_arrays([*blank, *columns, pa.array([part] * len(edges), pa.int32())], names=names)

    names = ["doc", "first", "last", *order, "part"]
    made = stored(dealt.mapInArrow(run, f"doc long, first long, last long, {_SUFFIX_DDL}, part int"), "suffix-spans")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for spans in _streamed(batches, min_words, gram):
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans, strict=True)], schema=_SPAN)

    # A few suffixes of each partition: those of n-grams that may go on beyond its boundaries.
    ends = made.where("part IS NOT NULL AND octet_length(right) > 0").select(*order).repartition("anchor").sortWithinPartitions(*order)
    ends = ends.mapInArrow(across, "doc_id long, first long, last long")
    # The windows whose run meets a boundary.
    cut = made.where("part IS NOT NULL AND octet_length(right) = 0").select("anchor", "doc_id", "pos")
    both = cut.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    cut = cut.join(both, "anchor", "left_semi").select("doc_id", F.col("pos").alias("first"), (F.col("pos") + min_words).alias("last"))
    spans = made.where("part IS NULL").select(F.col("doc").alias("doc_id"), "first", "last").union(ends).union(cut).distinct()

    inside = Window.partitionBy("doc_id").orderBy("first", "last")
    reached = F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("new", F.when(reached >= F.col("first"), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc_id", "run").agg(F.min("first").alias("first_word"), F.max("last").alias("last_word"))
    return out.select("doc_id", "first_word", "last_word", (F.col("last_word") - F.col("first_word")).alias("n_words"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM w WHERE len(w) >= 50)),
r AS (SELECT g FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
p AS (SELECT DISTINCT doc_id, s FROM g JOIN r USING (g)),
b AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS begins FROM p),
n AS (SELECT doc_id, s, sum(begins) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM b)
SELECT doc_id, min(s) AS first_word, max(s) + 50 AS last_word, max(s) + 50 - min(s) AS n_words
FROM n GROUP BY doc_id, run
"""
