import hashlib
import io
import struct

import pytest
import zstandard

from copperline.llm import warc


def archive(records):
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    return out.getvalue()


def records(n=300):
    return [warc.make_record(k, f"http://x/{k}", (f"<html>{k} " + "body " * (k % 40)).encode()) for k in range(n)]


def test_archive_round_trip():
    for own in (records(), records(1), [warc.make_record(None, None, b"")]):
        data = archive(own)
        assert struct.unpack("<I", data[:4])[0] == warc.DICTIONARY_MAGIC
        assert list(warc.read_archive(io.BytesIO(data))) == own


def test_every_record_is_a_frame_of_its_own():
    own = records(20)
    data = archive(own)
    n = struct.unpack("<I", data[4:8])[0]
    dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    rest, count = data[8 + n :], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj()
        assert one.decompress(rest) == own[count]
        rest, count = one.unused_data, count + 1
    assert count == 20


def test_damage_is_found():
    data = archive(records(40))
    with pytest.raises(warc.WarcError, match="cut"):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(warc.WarcError, match="dictionary"):
        list(warc.read_archive(io.BytesIO(data[8:])))
    broken = bytearray(data)
    broken[-6] ^= 255
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(bytes(broken))))
    record = warc.make_record(1, "http://x", b"payload")
    assert warc.page_of(*warc.parse_record(record))[:5] == (1, 7, hashlib.sha1(b"payload").hexdigest(), "response", None)
    for bad in (record.replace(b"payload", b"payloaf"), record.replace(b"WARC/1.1", b"HTTP/1.1"), record[:-1], record.replace(b"WARC-Date", b"WARC-Dote"), record.replace(b"Content-Length", b"Content-Langth")):
        with pytest.raises(warc.WarcError):
            warc.page_of(*warc.parse_record(bad))


def test_pages_with_repeats_and_nulls(spark, tmp_path):
    big = "x" * 1000
    rows = [(1, "u", big), (7, "u", big), (7, "u", big), (3, None, big), (None, "u", big), (2, "u", "short"), (4, "u", "short"), (5, "a b\nc é", None), (6, "", ""), (8, "u", "é" * 500), (9, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, "z", 0) for r in rows], "page_id long, url string, html string, digest string, refers_to long")
    manifest = warc.write_archives(pages)
    got = warc.read_manifest(manifest).collect()
    assert len(got) == len(rows)
    kinds = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got)
    assert kinds == [(-1, "revisit", 7), (1, "revisit", 7), (2, "response", None), (3, "revisit", 7), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "response", None), (8, "revisit", 9), (9, "response", None)]
    for r in got:
        payload = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payload
    folder = manifest.first().path.rpartition("/")[0]
    assert warc.read_files(spark, folder).count() == len(rows)
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_manifest(empty, ["page_id", "payload_bytes"]).count() == 0


def test_archives_roll(spark):
    pages = spark.range(1500).selectExpr("id page_id", "'u' url", "repeat(sha2(string(id), 512), 20) html").coalesce(1)
    manifest = warc.write_archives(pages, archive_bytes=4000)
    assert manifest.count() > 1 and warc.read_manifest(manifest, ["page_id"]).distinct().count() == 1500
