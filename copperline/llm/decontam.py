"""Benchmark decontamination with one Aho-Corasick automaton (operator 6).

Test items and documents are normalised to words by byte tables. Every window of ``window`` consecutive item words
(a shorter item is one window) is a pattern over words. The automaton of all patterns is a few flat arrays: its
states are the patterns' prefixes, numbered level by level in the order of (parent, word), so that the array of
these keys is sorted and a transition is a binary search; each state has its failure link and the nearest state at
which a pattern ends. Tasks build it from the benchmark and write it to the shared folder; Python workers load it.

A text is split and scanned once. Words in which no two neighbours stand together in any pattern can't hold one: a
table of bits over the neighbours of the whole benchmark passes them over, some two to four bytes for each two
neighbours. The runs that are left become numbers of the vocabulary and go through the automaton in lanes that step
together, each after a lead of window - 1 words. Hits map to words and to byte spans of the original text. Words are
known by 64-bit hashes; those of a hit are compared byte by byte.

The automaton of a benchmark over ``AUTOMATON_BYTES`` of text lies in several files of about that much text each, so
that a worker needs to hold one at a time. Documents are still read, split and screened once and never rewritten: a
task holds ``GROUP_BYTES`` of them, and only the runs that the screen left in these go through the files.

Defined results: null or empty text has no words and no hits. An item without words, text or id is no item.
Items that share a window are all reported; item rows with one id are one item. Repeated document rows give
repeated rows. Without items nothing is contaminated. Long texts are scanned whole. Extra columns are not looked at.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperline.llm import bytesplit
from copperline.llm.common import shared_path, stored

WINDOW = 10
#: Item text of one automaton: some forty bytes of arrays for each byte of text.
AUTOMATON_BYTES = 2 << 20
#: Bytes of documents that a task passes all parts of a large benchmark over.
GROUP_BYTES = 64 << 20
#: Words of a lane.
LANE = 256

#: Bytes that are no part of a word: ASCII but digits and letters.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[b for b in range(128) if not chr(b).isalnum()]] = True


def _find(ordered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in an ascending array, -1 for those that are not in it."""
    if not len(ordered):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return np.where(ordered[at] == wanted, at, -1)


def _gathered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of data[start : start + len], end to end."""
    begin = np.cumsum(lens) - lens
    return data[np.repeat(starts - begin, lens) + np.arange(int(lens.sum()))]


#: Odd factors of the hash of two neighbours.
_ONE, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Runs:
    """Words of texts that may be part of a pattern, in order."""

    text: np.ndarray  # the word's text
    place: np.ndarray  # its number among the text's words
    low: np.ndarray  # its first byte in the text
    high: np.ndarray  # the byte past its last
    hashes: np.ndarray
    data: np.ndarray  # the lower-cased bytes of all these words, end to end
    starts: np.ndarray  # where each word begins in them, and where the last ends


class Screen:
    """A table of bits over the neighbours in patterns, and the patterns of one word; both may let other words pass."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """Of the (neighbours, singles, least) of each part of the automaton; ``least`` is the shortest of longer patterns."""
        total = sum(len(neighbours) for neighbours, _, _ in parts)
        self.shift = np.uint64(64 - max(10, (16 * total).bit_length()))
        self.table = np.zeros(1 << (61 - int(self.shift)), np.uint8)
        for neighbours, _, _ in parts:
            spot = neighbours >> self.shift
            np.bitwise_or.at(self.table, spot >> np.uint64(3), np.left_shift(1, spot & np.uint64(7)).astype(np.uint8))
        self.singles = np.unique(np.concatenate([singles for _, singles, _ in parts])) if parts else np.zeros(0, np.uint64)
        self.least = min((int(least[0]) for _, _, least in parts if least[0]), default=0)

    @staticmethod
    def neighbours(hashes: np.ndarray) -> np.ndarray:
        """The hash of each word and the next."""
        return hashes[:-1] * _ONE + hashes[1:] * _NEXT

    def passed(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The words, of texts with these bounds, that stand in runs of neighbours long enough for a pattern, or are one."""
        n = len(hashes)
        keep = np.zeros(n, bool)
        if self.least:
            both = np.zeros(n + 1, bool)  # word k and the next
            for a in range(0, n - 1, bytesplit.SPAN_BYTES):
                spot = self.neighbours(hashes[a : a + bytesplit.SPAN_BYTES + 1]) >> self.shift
                both[a : a + len(spot)] = self.table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1
            begun = bounds[1:-1]
            both[begun[(begun > 0) & (begun < n)] - 1] = False
            edges = np.flatnonzero(both[1:] != both[:-1]) + 1
            edges = np.concatenate([[0], edges]) if both[0] else edges
            low, high = edges[::2], edges[1::2]
            long = high - low >= self.least - 1
            change = np.zeros(n + 1, np.int8)
            change[low[long]] += 1
            change[high[long] + 1] -= 1
            keep = np.cumsum(change[:n], dtype=np.int8) > 0
        if len(self.singles):
            keep |= _find(self.singles, hashes) >= 0
        return np.flatnonzero(keep)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Runs | None]:
        """(number of words of each text, the words that pass)."""
        starts, ends, bounds = bytesplit.words(data, offsets, _BETWEEN)
        n_words, base = np.diff(bounds), int(offsets[0])
        if not len(starts) or not (self.least or len(self.singles)):
            return n_words, None
        folded = bytesplit.LOWER[data[base : int(offsets[-1])]]
        hashes = bytesplit.hash_pieces(folded, starts - base, ends - base)
        at = self.passed(hashes, bounds)
        if not len(at):
            return n_words, None
        text = np.searchsorted(bounds, at, "right") - 1
        lens = ends[at] - starts[at]
        own = offsets[text]
        held = _gathered(folded, starts[at] - base, lens)
        return n_words, Runs(text, at - bounds[text], starts[at] - own, ends[at] - own, hashes[at], held, np.concatenate([[0], np.cumsum(lens)]))


class Automaton:
    """Patterns over words; state 0 is the root, state k + 1 has the key keys[k] = parent * words + word."""

    #: Arrays of the automaton: vocabulary (hashes, ascending) with the words' bytes, keys, links, patterns' owners.
    FIELDS = ("vocabulary", "word_bytes", "word_starts", "keys", "fail", "ends", "depth", "owner_starts", "owners", "items")
    #: What the screen of all words is made of.
    SCREEN = ("neighbours", "singles", "least")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.FIELDS + self.SCREEN:
            setattr(self, name, arrays[name])
        self.n_words = max(1, len(self.vocabulary))

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> Automaton:
        """The automaton of (item, text) rows."""
        names, item_of = np.unique(np.array([i for i, _ in items], object).astype(str), return_inverse=True) if items else (np.zeros(0, str), np.zeros(0, np.int64))
        raw = [t.encode() for _, t in items]
        data = bytesplit.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw], dtype=np.int64)])
        starts, ends, bounds = bytesplit.words(data, offsets, _BETWEEN)
        hashes = bytesplit.hash_pieces(data, starts, ends)
        vocabulary, at, word = np.unique(hashes, return_index=True, return_inverse=True)
        lens = (ends - starts)[at]
        n_words = np.diff(bounds)
        counts = np.where(n_words > 0, np.maximum(n_words - window, 0) + 1, 0)  # windows of each item row
        owner = np.repeat(item_of, counts)
        begin = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        size = np.repeat(np.minimum(n_words, window), counts)

        v, state = max(1, len(vocabulary)), np.zeros(len(begin), np.int64)
        keys, fail, ends_at, depth = [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int8)]
        total = 1
        for k in range(int(size.max()) if len(size) else 0):
            alive = np.flatnonzero(size > k)
            level, of = np.unique(state[alive] * v + word[begin[alive] + k], return_inverse=True)
            state[alive] = total + of
            keys.append(level)
            every, links = np.concatenate(keys), np.concatenate(fail)
            back, symbol, link = links[level // v], level % v, np.zeros(len(level), np.int64)
            open_ = np.flatnonzero(level // v != 0)  # states of the first level fall back to the root
            while len(open_):
                to = _find(every, back[open_] * v + symbol[open_]) + 1
                link[open_] = to
                open_ = open_[(to == 0) & (back[open_] != 0)]
                back[open_] = links[back[open_]]
            fail.append(link)
            here = np.zeros(len(level), bool)
            here[of[size[alive] == k + 1]] = True
            ends_at.append(np.where(here, total + np.arange(len(level)), np.concatenate(ends_at)[link]))
            depth.append(np.full(len(level), k + 1, np.int8))
            total += len(level)
        owned = np.unique(np.stack([state, owner], 1), axis=0) if len(state) else np.zeros((0, 2), np.int64)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        # Neighbours in patterns: words of items that follow one another.
        follow = np.ones(max(len(word) - 1, 0), bool)
        follow[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(word))] - 1] = False
        longer = size[size > 1]
        return cls({
            "vocabulary": vocabulary, "word_bytes": _gathered(data, starts[at], lens), "word_starts": np.concatenate([[0], np.cumsum(lens)]),
            "keys": keys, "fail": np.concatenate(fail).astype(np.int32), "ends": np.concatenate(ends_at).astype(np.int32), "depth": np.concatenate(depth),
            "owner_starts": np.searchsorted(owned[:, 0], np.arange(total + 1)).astype(np.int32), "owners": owned[:, 1].astype(np.int32), "items": names,
            "neighbours": np.unique(Screen.neighbours(hashes)[follow]), "singles": np.unique(hashes[begin[size == 1]]), "least": np.array([longer.min() if len(longer) else 0]),
        })

    def packed(self, names: tuple[str, ...] = FIELDS + SCREEN) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in names})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        with np.load(io.BytesIO(data)) as arrays:
            return cls({name: arrays[name] for name in cls.FIELDS + cls.SCREEN})

    def _stepped(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state of each lane after its word; -1 is a word of no pattern."""
        state = np.where(word < 0, 0, state)
        out = np.zeros(len(state), np.int64)
        open_ = np.flatnonzero(word >= 0)
        while len(open_):
            to = _find(self.keys, state[open_] * self.n_words + word[open_]) + 1
            out[open_] = to
            open_ = open_[(to == 0) & (state[open_] != 0)]
            state[open_] = self.fail[state[open_]]
        return out

    def _run(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, state) of each word of a stream at which patterns end."""
        lead = int(self.depth.max()) - 1
        n_lanes = -(-len(words) // LANE)
        padded = np.full(lead + n_lanes * LANE, -1, np.int64)
        padded[lead : lead + len(words)] = words
        first = np.arange(n_lanes) * LANE
        state, places, states = np.zeros(n_lanes, np.int64), [], []
        for k in range(lead + LANE):
            state = self._stepped(state, padded[first + k])
            if k >= lead and len(hit := np.flatnonzero(self.ends[state])):
                places.append(first[hit] + k - lead)
                states.append(self.ends[state[hit]].astype(np.int64))
        return (np.concatenate(places), np.concatenate(states)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, and what ``hits`` gives) of texts that no other part of the automaton sees."""
        n_words, runs = Screen([(self.neighbours, self.singles, self.least)]).runs(data, offsets)
        return n_words, *(self.hits(runs) if runs else (np.zeros((0, 5), np.int64), np.zeros((0, 2), np.int64)))

    def hits(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences: text, first word, last word, first byte, byte past the last; (text, item) pairs)."""
        none = np.zeros((0, 5), np.int64), np.zeros((0, 2), np.int64)
        if not len(self.keys):
            return none
        word = _find(self.vocabulary, runs.hashes)
        # The words as one stream, with a break wherever words are missing or a text begins.
        gap = np.concatenate([[False], (np.diff(runs.place) != 1) | (np.diff(runs.text) != 0)])
        spot = np.arange(len(word)) + np.cumsum(gap)
        stream = np.full(int(spot[-1]) + 1, -1, np.int64)
        stream[spot] = word
        place, state = self._run(stream)
        last = np.searchsorted(spot, place)
        found = []
        while len(state):  # the patterns that end there, the longest first
            found.append((last, state))
            further = self.ends[self.fail[state]].astype(np.int64)
            last, state = last[further > 0], further[further > 0]
        if not found:
            return none
        last, state = (np.concatenate(x) for x in zip(*found, strict=True))
        first = last - self.depth[state] + 1
        last, state, first = (x[self._same(runs.data, runs.starts[:-1], runs.starts[1:], word, first, last)] for x in (last, state, first))
        text = runs.text[first]
        n_owners = self.owner_starts[state + 1] - self.owner_starts[state]
        met = np.stack([np.repeat(text, n_owners), _gathered(self.owners, self.owner_starts[state], n_owners)], 1)
        out = np.stack([text, runs.place[first], runs.place[last], runs.low[first], runs.high[last]], 1)
        return out[np.argsort(text, kind="stable")], np.unique(met, axis=0)

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Whether all words of each occurrence are the pattern's, byte by byte."""
        edge = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, last + 1, -1)
        at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        lens, own = ends[at] - starts[at], word[at]
        good = lens == np.diff(self.word_starts)[own]
        checked = np.flatnonzero(good)
        equal = _gathered(data, starts[at[checked]], lens[checked]) == _gathered(self.word_bytes, self.word_starts[own[checked]], lens[checked])
        if not equal.all():
            good[checked] = np.logical_and.reduceat(equal, np.cumsum(lens[checked]) - lens[checked])
        bad = np.zeros(len(starts) + 1, np.int64)
        bad[at + 1] = ~good
        bad = np.cumsum(bad)
        return bad[last + 1] == bad[first]


def merged(found: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Union of closed word spans (first, last, first byte, byte past the last), in order."""
    out: list[list[int]] = []
    for first, last, a, b in found[np.lexsort((found[:, 1], found[:, 0]))].tolist():
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1][1], out[-1][3] = last, b
        else:
            out.append([first, last, a, b])
    return [tuple(x) for x in out]


_LOADED: dict[str, Automaton] = {}
_SCREENS: dict[tuple[str, ...], Screen] = {}
#: The ending of the file beside a part's that holds what the screen needs of it.
_BESIDE = "-screen"


def _file(path: str) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return f.read()


def _automaton(path: str) -> Automaton:
    """The automaton of a file; a worker keeps the last."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Automaton.unpacked(_file(path))
    return _LOADED[path]


def _screen(paths: list[str]) -> Screen:
    """The screen of all parts; a worker keeps the last."""
    if tuple(paths) not in _SCREENS:
        _SCREENS.clear()
        parts = []
        for path in paths:
            with np.load(io.BytesIO(_file(path + _BESIDE))) as arrays:
                parts.append(tuple(arrays[name] for name in Automaton.SCREEN))
        _SCREENS[tuple(paths)] = Screen(parts)
    return _SCREENS[tuple(paths)]


def automata(benchmark: DataFrame, item_col: str, text_col: str, window: int, automaton_bytes: int) -> list[str]:
    """Build the automaton of a benchmark in tasks; the paths of its files, one for each ``automaton_bytes`` of text."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("words")).where("item IS NOT NULL AND words IS NOT NULL").distinct()
    size = tests.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    folder = shared_path(benchmark.sparkSession, "automata")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: dict[int, list[tuple[str, str]]] = {}
        for batch in batches:
            for part, item, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                held.setdefault(part, []).append((item, text))
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for part in sorted(held):
            name = f"{part:05d}-{uuid.uuid4().hex}"
            machine = Automaton.of(held.pop(part), window)
            for ending, fields in (("", Automaton.FIELDS + Automaton.SCREEN), (_BESIDE, Automaton.SCREEN)):
                with system.open_output_stream(f"{base}/{name}{ending}") as f:
                    f.write(machine.packed(fields))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    dealt = tests.select(F.pmod(F.xxhash64("item", "words"), F.lit(parts)).cast("int").alias("part"), "item", "words").repartition(parts, "part")
    return sorted(r.path for r in stored(dealt.mapInArrow(build, "path string"), "decontam-parts").collect())  # a row a part


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, keep: list[str] = ()) -> DataFrame:
    """docs' id, text and ``keep`` with n_words, spans (hit words), bytes (hit bytes of the UTF-8 text, last inclusive) and items (sorted ids)."""
    paths = automata(benchmark, item_col, item_text_col, window, automaton_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    made = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<first:long,last:long>>"), "bytes": F.array().cast("array<struct<first:long,last:long>>"), "items": F.array().cast("array<string>")})

    names = made.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = _screen(paths)
        for group in _grouped(batches, GROUP_BYTES if len(paths) > 1 else 0):
            n_words = [np.zeros(b.num_rows, np.int64) for b in group]
            found: list[dict[int, list[np.ndarray]]] = [{} for _ in group]
            items: list[dict[int, set[str]]] = [{} for _ in group]
            left: list[tuple[int, int, Runs]] = []
            for g, batch in enumerate(group):
                data, offsets = bytesplit.text_buffer(batch.column(1))
                for i, j in bytesplit.spans(offsets, 8 * bytesplit.SPAN_BYTES):
                    n_words[g][i:j], runs = screen.runs(data, offsets[i : j + 1])
                    if runs:
                        left.append((g, i, runs))
            for path in paths if left else ():
                machine = _automaton(path)
                for g, i, runs in left:
                    hits, met = machine.hits(runs)
                    for own in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1) if len(hits) else ():
                        found[g].setdefault(i + int(own[0, 0]), []).append(own[:, 1:])
                    for d, item in met.tolist():
                        items[g].setdefault(i + d, set()).add(str(machine.items[item]))
            for g, batch in enumerate(group):
                spans = [merged(np.concatenate(found[g][d])) if d in found[g] else () for d in range(batch.num_rows)]
                out = [
                    pa.array(n_words[g], pa.int64()),
                    pa.array([[(a, b) for a, b, _, _ in x] for x in spans], _SPANS),
                    pa.array([[(a, b - 1) for _, _, a, b in x] for x in spans], _SPANS),
                    pa.array([sorted(items[g].get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    return rows.mapInArrow(scan, made.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit bytes of its text."""
    rows = mark(docs, benchmark, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, s, k, item_id FROM dw JOIN iw USING (g, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
