"""Periodic run detection in texts: Lyndon arrays of both orders of the words, with extensions reused (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
max(``LEAST``, ``TIMES`` * q) that no neighbouring word extends keeping the period.

1. Words become numbers by an exact dictionary of their bytes; the numbers are the ordered alphabet.
2. ``edges`` walks the suffixes from left to right with the stack of previous smaller suffixes. It finds for each
   suffix the next smaller one, which ends the longest Lyndon word that starts there, and how far the two agree.
   Comparisons are never repeated: the farthest matched stretch is remembered with its shift, and pairs inside it take
   the length of the pair that lies a shift to the left; pairs down the stack take what the pair above has settled.
   Only words past the farthest match are compared, so the work is linear. No suffix array or tree and no hash is used.
3. In one of the two orders each Lyndon root of a run is the longest Lyndon word at its place, so both arrays together
   name all runs. A root that agrees with what follows for two periods is a candidate; it is extended to the left.
4. Before that, ``stretches`` leaves out places that can be in no such run: past its first period, every word of a run
   has stood at most q words before. Exact, and over all words of a batch at once.

Spark deals the documents; a task holds one Arrow batch and its rows' results. Memory follows the longest text, some
fifty bytes a word in Python's arrays where it is periodic.

Defined results: null or empty text, or text of white space, has no words: n_runs 0, four nulls, and the digests of
nothing. A row with a null id keeps its words as they are. Repeated rows each give a row. Equal longest runs: the one
that starts first, then the shorter period. Whole texts are searched, of any length. An empty table gives no rows. Extra
columns are not looked at.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperline.llm import bytesplit

#: Words of a run at least, and periods that it holds at least.
LEAST, TIMES = 6, 4
#: Words that are joined at once for a digest.
JOINED = 1 << 16


def edges(symbols: array) -> tuple[array, array]:
    """(next smaller suffix, words that both share) of each suffix of ``symbols``, which are not negative.

    The end counts as a symbol smaller than all; a suffix without a smaller one gets the end.
    """
    n = len(symbols)
    w = symbols + array("q", [-1])
    after, agree = array("q", [n]) * n, array("q", [0]) * n  # of each suffix with the next smaller one
    before, shared = array("q", [-1]) * n, array("q", [0]) * n  # of each suffix with the previous smaller one
    near = shift = reach = 0  # [near, reach) equals what stands ``shift`` words before
    for j in range(1, n):
        i, k, known = j - 1, 0, False
        while True:
            if not known:  # how far i and j agree: at least k
                grow = True
                if j + k < reach and i >= near:
                    a, b = i - shift, j - shift
                    if after[a] == b or before[b] == a:
                        k = agree[a] if after[a] == b else shared[b]
                        grow = j + k >= reach
                        if grow:
                            k = reach - j
                if grow:
                    while w[i + k] == w[j + k]:
                        k += 1
                    if j + k > reach:
                        near, shift, reach = j, j - i, j + k
            if w[i + k] < w[j + k]:
                before[j], shared[j] = i, k
                break
            after[i], agree[i] = j, k
            below = before[i]
            if below < 0:
                break
            if shared[i] < k:
                before[j], shared[j] = below, shared[i]
                break
            known = shared[i] > k
            i = below
    return after, agree


def repetitions(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``codes`` with at least ``times`` periods, by start and period; times is 2 or more."""
    n, found = len(codes), {}
    for way in (codes.astype(np.int64), int(codes.max(initial=0)) - codes.astype(np.int64)):
        w = array("q", way.tobytes())
        after, agree = (np.frombuffer(x, np.int64) for x in edges(w)) if n else (np.zeros(0, np.int64),) * 2
        here = np.arange(n)
        period = after - here
        root = (after < n) & (agree >= np.maximum((times - 2) * period, 1))
        earlier = np.maximum(here - period, 0)
        root &= ~((here >= period) & (after[earlier] == here) & (agree[earlier] >= period))  # the run's first root only
        for i, p in zip(np.flatnonzero(root).tolist(), period[root].tolist(), strict=True):
            left = 0
            while left < i and w[i - 1 - left] == w[i + p - 1 - left]:
                left += 1
            length = left + p + int(agree[i])
            if length >= max(least, times * p):
                found[i - left, p] = length
    return sorted((start, length, p) for (start, p), length in found.items())


def stretches(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint places [a, b) of ``codes``, each in one row of ``bounds``, that hold all runs.

    A run of length L and period q has L - q words, (times - 1) * q at least, that each stood at most q words before.
    """
    n = len(codes)
    if n < least:
        return []
    order = np.argsort(codes, kind="stable")
    back = np.full(n, n + 1)
    same = codes[order[1:]] == codes[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    row_of = np.repeat(bounds[:-1], np.diff(bounds))
    back[np.arange(n) - back < row_of] = n + 1
    cover = np.zeros(n + 1, np.int64)
    low, longest = max(1, min(least - least // times, times)), int(np.diff(bounds).max(initial=0))
    while low <= longest:
        high = max(low + 1, low * 3 // 2)  # stretches of [low, high) words, and the periods that they allow
        widest = max(1, (high - 1) // (times - 1))
        close = np.concatenate([[False], back <= widest, [False]])
        turns = np.flatnonzero(close[1:] != close[:-1])
        starts, ends = turns[::2], turns[1::2]
        long = ends - starts >= low
        starts, ends = starts[long], ends[long]
        np.add.at(cover, np.maximum(starts - widest, row_of[starts] if len(starts) else 0), 1)
        np.add.at(cover, ends, -1)
        low = high
    inside = np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    out = []
    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        cuts = bounds[(bounds > a) & (bounds < b)].tolist()
        out += [(x, y) for x, y in zip([a, *cuts], [*cuts, b], strict=True) if y - x >= least]
    return out


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same number for the same word and another for another: places in a dictionary of the words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    low, high = int(starts[0]), int(ends[-1])
    whole = data[low:high]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    own = pa.py_buffer(np.ascontiguousarray(whole[~bytesplit.WHITE[whole]]))
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), own])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the repetition that the document's id asks for, if any."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """SHA-256 of the words, joined by one space."""
    total, raw = sha256(), memoryview(data)
    for k in range(0, len(starts), JOINED):
        total.update(b" " * (k > 0) + b" ".join([raw[a:b] for a, b in zip(starts[k : k + JOINED].tolist(), ends[k : k + JOINED].tolist(), strict=True)]))
    return total.hexdigest()


def described(data: np.ndarray, offsets: np.ndarray, ids: list[int | None], rewrite: bool) -> Iterator[tuple]:
    """A result row for each row of text; ``rewrite`` puts in the repetitions that ids ask for."""
    starts, ends, bounds = bytesplit.words(data, offsets)
    codes = word_codes(data, starts, ends)
    if rewrite:
        source = np.arange(len(starts))
        for doc_id, low, high in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if asked := planted(doc_id, high - low):
                a, p = asked
                source[low + a : high] = low + a + np.arange(high - low - a) % p
        starts, ends, codes = starts[source], ends[source], codes[source]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    keep = np.ones(len(starts), bool)
    for a, b in stretches(codes, bounds):
        row = int(np.searchsorted(bounds, a, "right")) - 1
        for start, length, period in repetitions(codes[a:b]):
            runs[row].append((a + start - int(bounds[row]), length, period))
            keep[a + start + period : a + start + length] = False
    for doc_id, own, low, high in zip(ids, runs, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None,) * 3
        listed = sha256("".join(f"{s},{n},{p}\n" for s, n, p in sorted(own, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
        kept = np.flatnonzero(keep[low:high]) + low
        yield doc_id, len(own), start, length, period, 1000 * length // period if own else None, listed, _digest(data, starts[kept], ends[kept])


_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document (see the module's text): the number of runs, the longest, and digests of all runs and of the
    text without what repeats. ``rewrite``: ids put repetitions into the texts first."""
    names, kinds = zip(*((n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in _DDL.split(", "))), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytesplit.text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in bytesplit.spans(offsets):
                rows = list(described(data, offsets[i : j + 1], ids[i:j], rewrite))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, _DDL)


ORACLE = r"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, string_split_regex(trim(coalesce(text, ''), E' \t\n\x0B\f\r'), '[\x20\x09-\x0D]+') AS split,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) AS h
  FROM documents),
shaped AS (
  SELECT doc_id, h, h // 10 AS g, CASE WHEN split = [''] THEN []::VARCHAR[] ELSE split END AS own FROM hashed),
placed AS (
  SELECT doc_id, own, len(own) AS n, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN g % len(own) END AS a, 3 + g % 8 AS parts FROM shaped),
rewritten AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN own ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN own[i + 1] ELSE own[a + (i - a) % (1 + (n - a) // parts) + 1] END) END AS w
  FROM placed),
word AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM rewritten),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair),
stretch AS (SELECT doc_id, min(i) AS s, q, count(*) + q AS len FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, s, len, min(q) AS q FROM stretch GROUP BY doc_id, s, len),
told AS (
  SELECT doc_id, count(*) AS n_runs, sha256(string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q)) AS runs_sha256,
    arg_min({'s': s, 'len': len, 'q': q}, {'l': -len, 's': s, 'q': q}) AS top
  FROM run GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.len AS length, top.q AS period, 1000 * top.len // top.q AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
