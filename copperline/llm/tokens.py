"""Batch encoding with public tokenizers: token counts (operator 5) and the encoder of operator 7.

Texts are cut at boundaries that the tokenizer's own pre-tokenizer always has, equal pieces of a batch are
encoded once by the library, and a bounded cache keeps what a Python worker has met. A piece is looked up by a
64-bit hash and then compared byte by byte with the piece that the cache holds; one that differs is encoded alone.

Safe boundaries exist for byte-level BPE files without a normalizer (``ByteLevel`` pre-tokenizer): no piece
of its pattern holds a non-space followed by white space, nor a letter followed by one of ``.,;:!?``, and no
special token holds white space. So a text is cut before a blank or a line feed that follows a character
other than white space, and before such punctuation after a letter. Other tokenizers get whole texts.

Defined results: null and empty text count 0 tokens and 0 bytes; repeated rows give repeated rows; an empty
table gives an empty result; other columns of the input are not looked at, whatever their names. Long texts are
encoded whole, in parts that end at safe boundaries.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copperline.llm import bytesplit

#: Pieces that a worker keeps, with their ids; with those of one more span they stay under 2**20, where arrays would double.
CACHE_PIECES = 900_000
#: Bytes of kept pieces.
CACHE_BYTES = 1 << 26
#: Slots of each of the two tables that find a kept piece by its hash; a piece that loses both its slots is encoded again.
SLOTS = 1 << 21
#: Longer pieces are encoded each time that they occur.
LONG_PIECE = 4096
#: Bytes of new pieces that go to the library at once.
BATCH_BYTES = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Last bytes of the UTF-8 forms of Unicode white space, and of ASCII white space and separators.
_WHITE_END = np.zeros(256, bool)
_WHITE_END[[*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions of ``data`` (one or more texts end to end) before which a byte-level BPE may be cut."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    last = data[:-1]
    latin = np.zeros(len(last), bool)  # U+00C0 to U+00FF but the signs for times and divide: never white space, letters
    latin[1:] = (data[:-2] == 0xC3) & (last[1:] != 0x97) & (last[1:] != 0xB7) & (last[1:] >= 0x80)
    solid = ~_WHITE_END[last] | latin
    return np.flatnonzero((_BLANK[data[1:]] & solid) | (_PUNCTUATION[data[1:]] & (_LETTER[last] | latin))) + 1


@lru_cache(maxsize=4)
def library(path: str):
    """(encode, cuttable): encode gives a list of id lists for a list of texts, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: model.encode(texts, num_threads=1)), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    pre = kind.get("pre_tokenizer") or {}
    special = all(not any(c.isspace() or c in ".,;:!?" for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in kind.get("added_tokens", []))
    plain = kind.get("normalizer") is None and kind.get("post_processor") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), plain and special


class Encoder:
    """Encodes runs of texts; one lives in each Python worker, for each tokenizer file."""

    def __init__(self, path: str):
        self.encode, self.cuttable = library(path)
        self.clear()

    def clear(self) -> None:
        self.slots = np.full((2, SLOTS), -1, np.int32)  # row of a kept piece, by the low or the high bits of its hash
        self.hashes = np.zeros(1024, np.uint64)  # of kept pieces
        self.lens = np.zeros(1024, np.int32)
        self.starts = np.zeros(1024, np.int32)
        self.ids = np.zeros(8192, np.uint32)
        self.sizes = np.zeros(1024, np.int32)  # of kept pieces, in bytes
        self.places = np.zeros(1024, np.int32)  # of kept pieces, in kept
        self.kept = np.zeros(8192, np.uint8)
        self.n_rows = self.n_ids = self.n_kept = 0

    def _add(self, texts: list[str]) -> int:
        """Encode texts, in batches of bounded bytes; the row of the first."""
        first, i = self.n_rows, 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH_BYTES):
                size += len(texts[j])
                j += 1
            got = self.encode(texts[i:j])
            lens = np.fromiter(map(len, got), np.int64, len(got))
            total = int(lens.sum())
            while self.n_rows + len(got) > len(self.lens):
                self.lens, self.starts = np.resize(self.lens, 2 * len(self.lens)), np.resize(self.starts, 2 * len(self.starts))
            while self.n_ids + total > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.lens[self.n_rows : self.n_rows + len(got)] = lens
            self.starts[self.n_rows : self.n_rows + len(got)] = self.n_ids + np.cumsum(lens) - lens
            self.ids[self.n_ids : self.n_ids + total] = np.fromiter(chain.from_iterable(got), np.uint32, total)
            self.n_rows += len(got)
            self.n_ids += total
            i = j
        return first

    def _slots(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes & np.uint64(SLOTS - 1)).astype(np.int64), (hashes >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash's kept piece, or -1."""
        low, high = self._slots(hashes)
        rows = self.slots[0][low]
        lost = np.flatnonzero((rows < 0) | (self.hashes[rows] != hashes))
        other = self.slots[1][high[lost]]
        rows[lost] = np.where((other >= 0) & (self.hashes[other] == hashes[lost]), other, -1)
        return rows.astype(np.int64)

    def _keep(self, row: int, hashes: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Keep pieces of different hashes, whose rows begin at ``row``."""
        lens = ends - starts
        begin = np.cumsum(lens) - lens
        total = int(lens.sum())
        while row + len(lens) > len(self.sizes):
            self.sizes, self.places, self.hashes = (np.resize(x, 2 * len(x)) for x in (self.sizes, self.places, self.hashes))
        while self.n_kept + total > len(self.kept):
            self.kept = np.resize(self.kept, 2 * len(self.kept))
        self.sizes[row : row + len(lens)] = lens
        self.places[row : row + len(lens)] = self.n_kept + begin
        self.kept[self.n_kept : self.n_kept + total] = own[np.repeat(starts - begin, lens) + np.arange(total)]
        self.n_kept += total
        self.hashes[row : row + len(lens)] = hashes
        (low, high), rows = self._slots(hashes), np.arange(row, row + len(lens), dtype=np.int32)
        free = self.slots[0][low] < 0
        self.slots[0][low[free]] = rows[free]
        lost = self.slots[0][low] != rows
        self.slots[1][high[lost]] = rows[lost]

    def _others(self, rows: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces that are not the kept ones of their rows."""
        lens = ends - starts
        other = self.sizes[rows] != lens
        begin = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum()))
        met = own if len(at) == len(own) else own[np.repeat(starts - begin, lens) + at]
        at += np.repeat(np.where(other, 0, self.places[rows]) - begin, lens)
        differ = np.flatnonzero(met != self.kept[np.minimum(at, len(self.kept) - 1)])
        other[np.searchsorted(begin, differ, "right") - 1] = True
        return np.flatnonzero(other)

    def rows_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each piece, first piece of each text and one past the last)."""
        if self.n_rows > CACHE_PIECES or self.n_ids > 8 * CACHE_PIECES or self.n_kept > CACHE_BYTES:
            self.clear()
        base = int(offsets[0])
        own = data[base : int(offsets[-1])]
        begins = np.zeros(len(own), bool)
        begins[offsets[:-1][offsets[1:] > offsets[:-1]] - base] = True
        if self.cuttable:
            begins[cut_points(own)] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(own))[: len(starts)]
        bounds = np.searchsorted(starts, offsets - base)
        rows = np.zeros(len(starts), np.int64)
        text = lambda k: own[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")
        long = ends - starts > LONG_PIECE
        if len(few := np.flatnonzero(long)):
            rows[few] = self._add([text(k) for k in few]) + np.arange(len(few))
        if len(rest := np.flatnonzero(~long)):
            hashes = bytesplit.hash_pieces(own, starts[rest], ends[rest])
            found = self._find(hashes)
            if len(new := np.flatnonzero(found < 0)):
                keys, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
                pieces = rest[new[first]]
                row = self._add([text(k) for k in pieces])
                self._keep(row, keys, own, starts[pieces], ends[pieces])
                found[new] = row + inverse
            rows[rest] = found
            if len(others := rest[self._others(rows[rest], own, starts[rest], ends[rest])]):  # an equal hash, other bytes
                rows[others] = self._add([text(k) for k in others]) + np.arange(len(others))
        return rows, bounds

    def _parts(self, data: np.ndarray, a: int, b: int) -> Iterator[np.ndarray]:
        """Offsets of parts of one text, of about SPAN_BYTES, that end at safe boundaries."""
        while b - a > bytesplit.SPAN_BYTES and self.cuttable:
            size = bytesplit.SPAN_BYTES
            while not len(cuts := cut_points(data[a : min(a + size, b)])) and a + size < b:
                size *= 2
            if not len(cuts):
                break
            yield np.array([a, a + int(cuts[-1])])
            a += int(cuts[-1])
        yield np.array([a, b])

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if len(offsets) == 2 and offsets[1] - offsets[0] > bytesplit.SPAN_BYTES:
            return sum(self._counts(data, part) for part in self._parts(data, *offsets.tolist()))
        return self._counts(data, offsets)

    def _counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, bounds = self.rows_of(data, offsets)
        sums = np.concatenate([[0], np.cumsum(self.lens[rows])])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, tokens of each text)."""
        if len(offsets) == 2 and offsets[1] - offsets[0] > bytesplit.SPAN_BYTES:
            parts = [self._encoded(data, part)[0] for part in self._parts(data, *offsets.tolist())]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        return self._encoded(data, offsets)

    def _encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, bounds = self.rows_of(data, offsets)
        lens = self.lens[rows]
        sums = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(self.starts[rows] - sums[:-1], lens) + np.arange(int(sums[-1]))
        return self.ids[at], sums[bounds[1:]] - sums[bounds[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``; see the module's text for defined cases."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytesplit.text_buffer(batch.column(1))
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j in bytesplit.spans(offsets):
                counts[i:j] = encoder(tokenizer_path).counts(data, offsets[i : j + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lengths, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > max_tokens)
