"""Vectorised splitting and hashing of whole Arrow batches of UTF-8 text.

A batch's texts lie end to end in one Arrow buffer. Words (or token pieces) are found with byte tables and
hashed with one polynomial per piece, so that Python runs per batch and not per word. Whatever needs arrays of
several entries a byte works on ``SPAN_BYTES`` at a time, also within one long text or word, so that a text of
any length costs its own bytes and a few entries a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, some fifty bytes of arrays each.
SPAN_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20260101))
_SYMBOL = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and odd multipliers)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets have one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def spans(offsets: np.ndarray, most: int = SPAN_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _sums(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The polynomial of each data[start : start + len]."""
    begin = np.cumsum(lens) - lens
    at = np.repeat(starts - begin, lens) + np.arange(int(lens.sum()))
    return np.add.reduceat(_SYMBOL[data[at]] * powers(int(lens.max()))[at - np.repeat(starts, lens)], begin)


def _long_sum(data: np.ndarray, start: int, size: int) -> np.uint64:
    """The polynomial of one long piece, part by part."""
    total = 0
    for k in range(0, size, SPAN_BYTES):
        n = min(SPAN_BYTES, size - k)
        part = int((_SYMBOL[data[start + k : start + k + n]] * powers(n)).sum(dtype=np.uint64))
        total += part * pow(int(_BASE), k, 1 << 64)
    return np.uint64(total % (1 << 64))


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[starts:ends]; pieces don't overlap and none is empty."""
    lens = ends - starts
    sums, bytes_to = np.zeros(len(starts), np.uint64), np.cumsum(lens)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(bytes_to, bytes_to[i] - lens[i] + SPAN_BYTES, "right"))
        if j <= i:
            j = i + 1
            sums[i] = _long_sum(data, int(starts[i]), int(lens[i]))
        else:
            sums[i:j] = _sums(data, starts[i:j], lens[i:j])
        i = j
    return mix(sums + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one past the last) of maximal runs of non-white bytes; rows never join."""
    base, end = int(offsets[0]), int(offsets[-1])
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(base, end, SPAN_BYTES):
        b = min(a + SPAN_BYTES, end)
        solid = np.zeros(b - a + 2, bool)  # with the byte before and the byte after
        low, high = max(a - 1, base), min(b + 1, end)
        solid[low - a + 1 : high - a + 1] = ~white[data[low:high]]
        first = np.zeros(b - a + 1, bool)
        first[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        own = solid[1:-1]
        starts.append(np.flatnonzero(own & (~solid[:-2] | first[:-1])) + a)
        ends.append(np.flatnonzero(own & (~solid[2:] | first[1:])) + a + 1)
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, word bounds of each row)."""
    starts, ends, bounds = words(data, offsets, white)
    base = int(offsets[0])
    return hash_pieces(LOWER[data[base : int(offsets[-1])]], starts - base, ends - base), bounds
