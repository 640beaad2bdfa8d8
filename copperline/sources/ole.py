"""Compound files (MS-CFB): reading a stream out of the container that schematic sheets come in."""

from __future__ import annotations

import io
import struct
import sys
from array import array
from collections.abc import Iterator

# Fixed values of the format.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
LITTLE_ENDIAN = 0xFFFE
LARGEST_SECTOR = 0xFFFFFFFA  # sector numbers above mark ends, free sectors and tables
STREAM, ROOT = 2, 5
DIFAT_IN_HEADER = 109
#: Bytes of a read at most, but for a larger sector.
READ = 1 << 20


class OleError(ValueError):
    """Not a compound file, or a damaged one."""


class CompoundFile:
    """Tables and directory of a container; its sectors are read where a stream asks for them.

    ``source`` is bytes or a seekable file. What is held of a file is its sector table, four bytes a sector, and the
    stream of small streams.
    """

    def __init__(self, source):
        self.source = io.BytesIO(source) if isinstance(source, bytes | bytearray | memoryview) else source
        head = self._bytes(0, 512)
        if head[:8] != MAGIC:
            raise OleError("Invalid OLE file: magic signature mismatch")
        if len(head) < 512:
            raise OleError("Invalid OLE file: header is cut")
        order, shift, mini_shift = struct.unpack_from("<HHH", head, 28)
        if order != LITTLE_ENDIAN:
            raise OleError("Invalid OLE file: unexpected byte order")
        self.sector_size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, _, self.cutoff, mini_fat, _, difat, n_difat = struct.unpack_from("<IIIIIII", head, 48)
        self.fat = self._fat(struct.unpack_from(f"<{DIFAT_IN_HEADER}I", head, 76), difat, n_difat)
        self.entries = self._directory(directory)
        self.mini_fat = self._numbers(self._chain(mini_fat, self.fat))
        root = next((e for e in self.entries if e[1] == ROOT), self.entries[0] if self.entries else None)
        self.mini_stream = b"".join(self._large(root[2], root[3])) if root and root[3] else b""

    def _bytes(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def _runs(self, sectors: array) -> Iterator[bytes]:
        """The sectors' bytes, neighbours in one read of bounded size."""
        most, k = max(1, READ // self.sector_size), 0
        while k < len(sectors):
            n = 1
            while n < most and k + n < len(sectors) and sectors[k + n] == sectors[k] + n:
                n += 1
            yield self._bytes((sectors[k] + 1) * self.sector_size, n * self.sector_size)  # the header takes one sector, whatever its size
            k += n

    def _numbers(self, sectors: array) -> array:
        out = array("I")
        for raw in self._runs(sectors):
            out.frombytes(raw[: len(raw) // 4 * 4])
        if sys.byteorder == "big":
            out.byteswap()
        return out

    def _fat(self, tables: tuple[int, ...], difat: int, n_difat: int) -> array:
        found = list(tables)
        for _ in range(n_difat):
            if difat >= LARGEST_SECTOR:
                break
            *more, difat = self._numbers(array("I", [difat]))
            found += more
        return self._numbers(array("I", [t for t in found if t < LARGEST_SECTOR]))

    @staticmethod
    def _chain(start: int, table: array) -> array:
        out = array("I")
        while start < LARGEST_SECTOR:
            if len(out) >= len(table) or start >= len(table):  # a chain without a loop has each sector once
                raise OleError("Sector chain too long, possible corruption")
            out.append(start)
            start = table[start]
        return out

    def _directory(self, start: int) -> list[tuple[str, int, int, int]]:
        """(name, type, first sector, size) of each entry that is in use."""
        raw = b"".join(self._runs(self._chain(start, self.fat)))
        out = []
        for at in range(0, len(raw) // 128 * 128, 128):
            name_bytes, kind = struct.unpack_from("<HB", raw, at + 64)
            first, size = struct.unpack_from("<II", raw, at + 116)
            if kind:
                out.append((raw[at : at + max(0, name_bytes - 2)].decode("utf-16-le", "replace"), kind, first, size))
        return out

    def _large(self, start: int, size: int) -> Iterator[bytes]:
        """A stream of whole sectors, piece by piece; what a cut file lacks of it is zeros."""
        left = size
        for piece in self._runs(self._chain(start, self.fat)):
            if left <= 0:
                return
            yield piece[:left]
            left -= len(piece)
        while left > 0:
            yield bytes(min(left, READ))
            left -= READ

    def _small(self, start: int, size: int) -> bytes:
        sectors = self._chain(start, self.mini_fat)
        return b"".join(self.mini_stream[n * self.mini_size : (n + 1) * self.mini_size] for n in sectors)[:size].ljust(size, b"\0")

    def streams(self) -> list[str]:
        return [name for name, kind, _, _ in self.entries if kind == STREAM]

    def pieces(self, name: str) -> Iterator[bytes]:
        """A stream's bytes in pieces of bounded size."""
        for own, kind, start, size in self.entries:
            if kind == STREAM and own.lower() == name.lower():
                if size < self.cutoff:
                    yield self._small(start, size) if size else b""
                else:
                    yield from self._large(start, size)
                return
        raise OleError(f'Stream "{name}" not found in OLE file')

    def read(self, name: str) -> bytes:
        return b"".join(self.pieces(name))


def read_stream(data: bytes, name: str = "FileHeader") -> bytes:
    return CompoundFile(data).read(name)
