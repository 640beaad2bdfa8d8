"""WARC archives in zstandard with a dictionary, one frame per record (operator 2).

An archive opens with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a zstandard
frame; then each record is one zstandard frame of its own, compressed with that dictionary, with its size and a
checksum. The reader loads the dictionary, decodes frame by frame in bounded windows, and validates version,
required headers, lengths, the record's end, digests and that no frame is cut.

Payloads that repeat (equal bytes, at least ``LEAST_REVISIT``) are stored once, in the record of the largest
page id; the others are ``revisit`` records with headers only. Which is which is settled on narrow rows (id,
digest, length) with a map-side combined maximum; page bodies are shuffled once, by page id.

Archives are written by the tasks, under names that no other attempt uses, to the shared folder; the manifest
is a Spark table whose commit decides which files count.

Defined results: null html is an empty payload. Null ids are kept as null and are never the largest; if all
ids of a group are null its records are responses. Rows with the largest id twice are both responses; a null
url becomes ``urn:page:<id>``. An empty table gives no archives and no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copperline.llm.common import shared_path, stored

LEAST_REVISIT = 1000
#: Fixed values of the format: magic of the dictionary's frame, of any zstandard frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of all records; a parameter of the writer.
DATE = "2026-01-01T00:00:00Z"
#: Records, and their bytes at most, that a dictionary is trained on: the first of an archive.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8 << 20, 32 << 10
#: Compressed bytes after which the next record opens a new archive.
ARCHIVE_BYTES = 64 << 20
WINDOW = 64 << 10


class WarcError(ValueError):
    """A damaged or invalid archive."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """A response record, or a revisit record of page ``refers_to``."""
    digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        out[name.strip().decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a whole record, validated."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"content-length is {n}, but {len(rest) - 4} bytes follow")
    block = rest[:n]
    if "warc-block-digest" in headers and headers["warc-block-digest"].startswith("sha1:") and headers["warc-block-digest"] != _sha1(block):
        raise WarcError("the block's digest differs")
    return headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None, str | None, bytes | None]:
    """(page id, payload bytes, payload sha1 in hex, type, page that is referred to, url, payload or None) of a record."""
    head, blank, payload = block.partition(b"\r\n\r\n")
    http = _headers(head.split(b"\r\n")[1:])
    if not blank or not http.get("content-length", "").isdigit():
        raise WarcError("no whole HTTP header")
    n, kind, digest = int(http["content-length"]), headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response":
        if len(payload) != n:
            raise WarcError(f"payload of {len(payload)} bytes, {n} were announced")
        if digest != _sha1(payload):
            raise WarcError("the payload's digest differs")
    elif kind != "revisit" or "x-refers-to-page-id" not in headers:
        raise WarcError(f"unexpected record type {kind}")
    own, other = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return (int(own) if own else None), n, base64.b32decode(digest.removeprefix("sha1:")).hex(), kind, (int(other) if other else None), headers.get("warc-target-uri"), payload if kind == "response" else None


class ArchiveWriter:
    """Writes one archive; the first records wait until a dictionary can be trained on them."""

    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.waiting: list[bytes] = []
        self.n_waiting = self.bytes = self.n_records = 0
        self.zstd: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.n_records += 1
        if self.zstd:
            self._put(self.zstd.compress(record))
            return
        self.waiting.append(record)
        self.n_waiting += len(record)
        if len(self.waiting) >= SAMPLE_RECORDS or self.n_waiting >= SAMPLE_BYTES:
            self._open()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _open(self) -> None:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting).as_bytes()
        except zstandard.ZstdError:  # too few or too short to train on: a plain prefix serves
            trained = b"".join(r[:2048] for r in self.waiting[:4])[:4096].ljust(8, b"\0")
        frame = zstandard.ZstdCompressor(level=self.level).compress(trained)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self.zstd = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True, write_content_size=True)
        for r in self.waiting:
            self._put(self.zstd.compress(r))
        self.waiting = []

    def close(self) -> int:
        if not self.zstd:
            self._open()
        self.out.close()
        return self.bytes


def read_archive(source) -> Iterator[bytes]:
    """The records of a binary file, each decoded from a frame of its own, in bounded windows."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_MAGIC:
        raise WarcError("no dictionary frame leads the archive")
    n = struct.unpack("<I", head[4:])[0]
    frame = source.read(n)
    if len(frame) != n:
        raise WarcError("the dictionary is cut")
    if frame[:4] == struct.pack("<I", FRAME_MAGIC):
        frame = zstandard.ZstdDecompressor().decompress(frame)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frame))
    rest = b""
    while True:
        rest = rest or source.read(WINDOW)
        if not rest:
            return
        while len(rest) < 4 and (more := source.read(WINDOW)):
            rest += more
        if rest[:4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError("a record's frame is expected")
        one, parts = decoder.decompressobj(), []
        try:
            while not one.eof:
                if not rest and not (rest := source.read(WINDOW)):
                    raise WarcError("a record's frame is cut")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
        except zstandard.ZstdError as e:
            raise WarcError(f"a damaged frame: {e}") from e
        yield b"".join(parts)


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat the payload of a larger id."""
    narrow = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= least)
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 AND refers_to IS NOT NULL")
    return narrow.join(groups, "digest").where("page_id IS NULL OR page_id <> refers_to").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to").distinct()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; the manifest (path, bytes, n_records), a stored table."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    again = revisits(rows, least)
    typed = rows.withColumn("digest", F.sha1("payload")).join(again.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, made, name = None, [], ""
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{part:06d}-{attempt}-{len(made):04d}.warc.zst"
                    out = ArchiveWriter(system.open_output_stream(f"{base}/{name}", compression=None))
                out.add(make_record(page_id, url, payload, refers_to))
                if out.bytes >= archive_bytes:
                    made.append((f"{folder}/{name}", out.close(), out.n_records))
                    out = None
        if out is not None:
            made.append((f"{folder}/{name}", out.close(), out.n_records))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "bytes", "n_records"])

    return stored(typed.mapInArrow(write, "path string, bytes long, n_records long"), "warc-manifest")


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
_PAGE_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _pages(records: Iterator[bytes], names: list[str]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    where = [_PAGE.names.index(n) for n in names]
    schema = pa.schema([_PAGE.field(n) for n in names])
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _PAGE.types[k]) for k in where], schema=schema)
    for record in records:
        page = page_of(*parse_record(record))
        rows.append(page if "payload" in names else (*page[:-1], None))
        held += page[1] if "payload" in names else 0
        if len(rows) >= 5000 or held >= 8 << 20:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def read_manifest(manifest: DataFrame, columns: list[str] = _PAGE.names) -> DataFrame:
    """Records of the archives that a manifest lists, one archive a task at a time, streamed from the shared folder."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as source:
                    got = 0
                    for out in _pages(read_archive(source), columns):
                        got += out.num_rows
                        yield out
                    if got != n:
                        raise WarcError(f"{path} has {got} records, its manifest says {n}")

    ddl = ", ".join(x for x in _PAGE_DDL.split(", ") if x.split()[0] in columns)
    order = [x.split()[0] for x in ddl.split(", ")]
    if order != list(columns):
        raise ValueError(f"columns must be in the order of {_PAGE.names}")
    return manifest.select("path", "n_records").repartition(max(1, manifest.count()), "path").mapInArrow(read, ddl)


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """Records of any archives that Spark can list, through its ``binaryFile`` source (an archive must fit a row)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _pages(read_archive(io.BytesIO(content.as_py())), _PAGE.names)

    return spark.read.format("binaryFile").load(glob).select("content").mapInArrow(read, _PAGE_DDL)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
g AS (SELECT digest, max(page_id) AS top FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN top IS NULL OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top IS NULL OR page_id = top THEN NULL ELSE top END AS refers_to
FROM d LEFT JOIN g USING (digest)
"""
