"""Token-id files with bit-plane shuffling (operator 7).

File layout (little-endian): the magic ``CLBP``, a version byte, a plane-kind byte (1: bit planes, 2: byte
planes) and two bytes of zero; then the chunks; then a zstandard frame with the index; then the index's
length as u64 and the magic again. A chunk holds one block of at most ``BLOCK`` ids, transposed into planes,
each a zstandard frame of its own. The index has, for each chunk, its offset, number of ids, number of planes,
crc32 of its ids and the planes' lengths, and, for each document, its id (with a null mark) and number of ids.

Documents are range-partitioned and sorted by id, so partition after partition holds the ids in ascending
order. A task writes its own files, under names that no other attempt uses, straight to the shared folder
through ``pyarrow.fs``, and returns one manifest row per file; the manifest is written as a Spark table, whose
commit decides which attempt's files count. Files roll at ``FILE_IDS`` ids, at the end of a document.

Defined results: null text counts as empty and gives the end id alone. Null ids come first. Rows with equal
ids are ordered by their text's first ``TIE_CHARS`` characters and then by a hash of the whole text, nulls first, so that one
id may fill many partitions and files dealt otherwise give the same rows; repeated rows are repeated. An empty table gives no rows and no files. Long texts are encoded whole,
in parts. Extra columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copperline.llm import bytesplit
from copperline.llm.common import shared_path, stored
from copperline.llm.tokens import encoder

MAGIC = b"CLBP"
VERSION = 1
BIT_PLANES, BYTE_PLANES = 1, 2
#: Ids of a chunk, and of a file (about 35 MB).
BLOCK = 1 << 16
FILE_IDS = 1 << 24
#: Characters of a text that order rows with equal ids.
TIE_CHARS = 64


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """Transpose a block of uint32 ids into as many planes as its largest id needs."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()) if len(ids) else 0
    if kind == BYTE_PLANES:
        return [raw[:, k].tobytes() for k in range(max(1, (top.bit_length() + 7) // 8))]
    bits = np.unpackbits(raw, axis=1, bitorder="little", count=max(1, top.bit_length()))
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    if kind == BYTE_PLANES:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
        return raw.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return ids


class FileWriter:
    """One file of ids; holds at most one block and the index in memory."""

    def __init__(self, out, kind: int = BIT_PLANES, block: int = BLOCK, level: int = 1):
        self.out, self.kind, self.block = out, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.chunks: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self.at = 8
        out.write(MAGIC + bytes([VERSION, kind, 0, 0]))

    def add(self, docs: np.ndarray, nulls: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.nulls.append(nulls)
        self.lens.append(lens)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block:
            rest = np.concatenate(self.waiting)
            whole = len(rest) // self.block * self.block
            for k in range(0, whole, self.block):
                self._chunk(rest[k : k + self.block])
            self.waiting, self.n_waiting = [rest[whole:]], len(rest) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        for p in planes:
            self.out.write(p)
        self.chunks.append((self.at, len(ids), len(planes), zlib.crc32(ids.astype("<u4").tobytes()), [len(p) for p in planes]))
        self.at += sum(map(len, planes))

    def close(self) -> int:
        """Write what waits and the index; the file's size."""
        if self.n_waiting:
            self._chunk(np.concatenate(self.waiting))
        docs, nulls, lens = (np.concatenate(x) for x in (self.docs, self.nulls, self.lens))
        parts = [struct.pack("<QQ", len(self.chunks), len(docs))]
        parts += [struct.pack(f"<QIHI{n}I", at, size, n, crc, *planes) for at, size, n, crc, planes in self.chunks]
        parts += [docs.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), lens.astype("<i8").tobytes()]
        index = self.zstd.compress(b"".join(parts))
        tail = index + struct.pack("<Q", len(index)) + MAGIC
        self.out.write(tail)
        self.out.close()
        return self.at + len(tail)


class FileReader:
    """Reads a file's index, then chunk by chunk."""

    def __init__(self, source, size: int):
        self.source = source
        head = source.read_at(8, 0)
        tail = source.read_at(12, size - 12) if size >= 20 else b""
        if head[:4] != MAGIC or tail[8:] != MAGIC or head[4] != VERSION:
            raise ValueError("not a whole id file")
        self.kind = head[5]
        self.zstd = zstandard.ZstdDecompressor()
        n = struct.unpack("<Q", tail[:8])[0]
        index = self.zstd.decompress(source.read_at(n, size - 12 - n))
        n_chunks, n_docs = struct.unpack_from("<QQ", index)
        at, self.chunks = 16, []
        for _ in range(n_chunks):
            offset, ids, planes, crc = struct.unpack_from("<QIHI", index, at)
            self.chunks.append((offset, ids, crc, struct.unpack_from(f"<{planes}I", index, at + 18)))
            at += 18 + 4 * planes
        self.docs = np.frombuffer(index, "<i8", n_docs, at)
        self.nulls = np.unpackbits(np.frombuffer(index, np.uint8, -(-n_docs // 8), at + 8 * n_docs), count=n_docs).astype(bool)
        self.lens = np.frombuffer(index, "<i8", n_docs, at + 8 * n_docs + -(-n_docs // 8))

    def chunk(self, k: int) -> np.ndarray:
        offset, n, crc, planes = self.chunks[k]
        data, at, out = self.source.read_at(sum(planes), offset), 0, []
        for size in planes:
            out.append(self.zstd.decompress(data[at : at + size]))
            at += size
        ids = from_planes(out, n, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(document's place, its first id's place in the file, its ids in pieces), in order."""
        k, have, used, start = -1, np.zeros(0, "<u4"), 0, 0
        for d, n in enumerate(self.lens.tolist()):
            left, pieces = n, []
            while left:
                if used == len(have):
                    k, used = k + 1, 0
                    have = self.chunk(k)
                take = min(left, len(have) - used)
                pieces.append(have[used : used + take])
                used, left = used + take, left - take
            yield d, start, pieces
            start += n


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", kind: int = BIT_PLANES, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode and write all rows; the manifest (part, file, path, bytes, n_docs, n_ids, start), a stored table."""
    spark = docs.sparkSession
    folder = shared_path(spark, "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, rows, name = None, [], ""
        for batch in batches:
            data, offsets = bytesplit.text_buffer(batch.column(1))
            column = batch.column(0)
            doc_ids, nulls = column.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(column.is_null())
            for i, j in bytesplit.spans(offsets, min(bytesplit.SPAN_BYTES, file_ids)):
                ids, lens = encoder(tokenizer_path).encoded(data, offsets[i : j + 1])
                ids = np.insert(ids, np.cumsum(lens), np.uint32(end_id))
                if out is None:
                    name = f"{len(rows):04d}"
                    out = FileWriter(system.open_output_stream(f"{base}/ids-{part:06d}-{attempt}-{name}"), kind, block)
                out.add(doc_ids[i:j], nulls[i:j], lens + 1, ids)
                if out.n_ids >= file_ids:
                    rows.append((f"ids-{part:06d}-{attempt}-{name}", sum(map(len, out.docs)), out.n_ids, out.close()))
                    out = None
        if out is not None:
            rows.append((f"ids-{part:06d}-{attempt}-{name}", sum(map(len, out.docs)), out.n_ids, out.close()))
        if rows:
            names, n_docs, n_ids, sizes = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"part": [part] * len(rows), "file": list(range(len(rows))), "path": [f"{folder}/{x}" for x in names], "bytes": list(sizes), "n_docs": list(n_docs), "n_ids": list(n_ids)}, schema=pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("bytes", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumns({"tie": F.struct(F.substring("text", 1, TIE_CHARS).alias("begin"), F.xxhash64("text").alias("whole")), "place": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place").drop("tie", "place")
    manifest = stored(dealt.mapInArrow(write, "part long, file long, path string, bytes long, n_docs long, n_ids long"), "ids-manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files of a manifest, and ids (uint32, little-endian bytes) if asked."""
    wide = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, size, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    file = FileReader(source, size)
                    rows: list[tuple] = []
                    held = 0
                    for d, start, pieces in file.documents():
                        crc = 0
                        for p in pieces:
                            crc = zlib.crc32(p.tobytes(), crc)
                        row = (None if file.nulls[d] else int(file.docs[d]), first + start, int(file.lens[d]), crc)
                        rows.append((*row, b"".join(p.tobytes() for p in pieces)) if with_ids else row)
                        held += int(file.lens[d])
                        if len(rows) >= 10_000 or with_ids and held >= 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), wide.types, strict=True)], schema=wide)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), wide.types, strict=True)], schema=wide)

    # A file is a task; without a number, adaptive execution would join these few rows into one partition.
    files = manifest.select("path", "bytes", "start").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
