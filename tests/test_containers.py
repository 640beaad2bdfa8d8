"""Compound files read by seeking: pieces, cut files, records over the borders of pieces, and memory."""

import io
import random
import tracemalloc

import pytest

from copperline.sources import altium, ole
from copperline.sources.writer import container, sheet, stream


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


def test_only_the_stream_that_is_asked_for_is_read(monkeypatch):
    monkeypatch.setattr(ole, "READ", 1500)
    rng = random.Random(1)
    big, other = rng.randbytes(50_000), rng.randbytes(400_000)
    for shift in (9, 12):
        source = Counted(container({"Other": other, "FileHeader": big, "Small": b"abc"}, shift=shift))
        pieces = list(ole.CompoundFile(source).pieces("FILEHEADER"))
        assert b"".join(pieces) == big and len(pieces) > 9 and max(map(len, pieces)) <= max(1500, 1 << shift)
        assert source.bytes_read < 90_000


def test_chains_that_jump_and_loop():
    data = bytearray(container({"A": bytes(range(256)) * 30, "B": b"b" * 6000}))
    file = ole.CompoundFile(bytes(data))
    (_, _, first, _) = next(e for e in file.entries if e[0] == "A")
    fat_at = (int.from_bytes(data[76:80], "little") + 1) * 512
    entry = fat_at + 4 * (first + 3)
    data[entry : entry + 4] = first.to_bytes(4, "little")  # the fourth sector leads back to the first
    with pytest.raises(ole.OleError, match="corruption"):
        ole.CompoundFile(bytes(data)).read("A")
    swapped = bytearray(container({"A": b"1" * 512 + b"2" * 512 + b"3" * 4000}))
    one, two = slice(512, 1024), slice(1024, 1536)  # sectors 0 and 1 change places, and so do their links
    swapped[one], swapped[two] = swapped[two], swapped[one]
    at = (int.from_bytes(swapped[76:80], "little") + 1) * 512
    swapped[at : at + 8] = (2).to_bytes(4, "little") + (0).to_bytes(4, "little")
    directory = (int.from_bytes(swapped[48:52], "little") + 1) * 512
    swapped[directory + 128 + 116 : directory + 128 + 120] = (1).to_bytes(4, "little")
    assert ole.CompoundFile(bytes(swapped)).read("A") == b"1" * 512 + b"2" * 512 + b"3" * 4000


def test_a_cut_file_ends_in_zeros():
    data = container({"A": b"x" * 9000})
    assert ole.CompoundFile(data).read("A") == b"x" * 9000
    fat_first = container({"A": b"x" * 9000})[: 512 * 40]
    assert len(ole.CompoundFile(fat_first).read("A")) == 9000


RECORDS = [{"HEADER": "h"}, {"RECORD": "1", "A": "a=b"}, {"RECORD": "2", "OwnerIndex": "0"}, {"RECORD": "2", "OwnerIndex": "3"}, {"X": "no record"}, {"RECORD": "2", "OWNERINDEX": "4"}, {"RECORD": "41", "OwnerIndex": "99", "Text": "é | "}]


@pytest.mark.parametrize("size", range(1, 40))
def test_records_over_the_borders_of_pieces(size):
    data = stream(RECORDS)
    chunks = [data[k : k + size] for k in range(0, len(data), size)]
    assert list(altium.record_stream(chunks)) == altium.record_fields(data)
    rows = sorted(r for batch in altium.record_batches(chunks) for r in batch)
    assert rows == altium.record_rows(data) and [r[2] for r in rows] == [None, 0, 3, 4, None]


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(altium, "BATCH_RECORDS", 10)
    rows = [{"RECORD": "2", "OwnerIndex": str(k // 2)} for k in range(95)]
    batches = list(altium.record_batches([stream(rows)]))
    assert [len(b) for b in batches] == [10] * 9 + [5] and [r[0] for b in batches for r in b] == list(range(95))


def test_a_large_sheet_in_little_memory(tmp_path):
    path = tmp_path / "large.SchDoc"
    path.write_bytes(sheet([{"RECORD": "41", "OwnerIndex": "0", "Name": "Value", "Text": "x" * 400}] * 150_000))
    size = path.stat().st_size
    tracemalloc.start()
    with open(path, "rb") as source:
        n = sum(len(rows) for rows in altium.record_batches(ole.CompoundFile(source).pieces("FileHeader")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 150_000 and size > 60 << 20 and peak < size / 3


def test_sheets_as_files_equal_their_contents(spark, tmp_path):
    rows = [{"RECORD": "1", "CurrentPartId": "1"}, {"RECORD": "34", "OwnerIndex": "0", "Text": "R1"}, {"RECORD": "2", "OwnerIndex": "0", "Designator": "1", "Location.X": "5", "Location.Y": "5"}]
    path = tmp_path / "a b.SchDoc"
    path.write_bytes(sheet(rows))
    files = spark.createDataFrame([("d", str(path), 0), ("d", f"{tmp_path}/none.SchDoc", 1), ("e", f"file://{tmp_path}/a%20b.SchDoc", 0)], "design_id string, sheet string, sheet_ord int")
    contents = spark.createDataFrame([("d", str(path), 0, path.read_bytes())], "design_id string, sheet string, sheet_ord int, content binary")
    got, wanted = altium.file_records(files).collect(), altium.records(contents).collect()
    assert sorted(map(repr, (r for r in got if r.design_id == "d"))) == sorted(map(repr, wanted)) and len(got) == 6
    broken = tmp_path / "broken.SchDoc"
    broken.write_bytes(b"no container")
    with pytest.raises(Exception, match="magic signature mismatch"):
        altium.file_records(files.limit(1).selectExpr("design_id", f"'{broken}' AS sheet", "sheet_ord")).collect()
