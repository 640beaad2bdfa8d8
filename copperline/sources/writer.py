"""Writing schematic sheets: record streams in compound files, the counterpart of ``ole`` and ``altium.record_fields``."""

import struct
from itertools import chain

END, FREE, FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def stream(records):
    """A record stream of any iterable of records: five leading bytes, records behind length, two zeros and a bar, one trailing byte."""
    out = bytearray(5)
    for k, fields in enumerate(records):
        raw = fields["raw"] if "raw" in fields else "|".join(f"{a}={b}" if isinstance(b, str) else a for a, b in fields.items()).encode()
        out += (b"" if k == 0 else struct.pack("<I", len(raw))[:3] + b"\x00\x00") + b"|" + raw
    out += b"\x00"
    return bytes(out)


def container(streams, shift=9, cutoff=4096):
    """A compound file with these streams; short ones go to the mini stream."""
    size = 1 << shift
    sectors, fat = [], []

    def put(data):
        start = len(sectors)
        n = -(-len(data) // size)
        for k in range(n):
            whole = (k + 1) * size <= len(data)
            sectors.append(memoryview(data)[k * size : (k + 1) * size] if whole else data[k * size :].ljust(size, b"\0"))  # a large stream is not copied
            fat.append(start + k + 1 if k + 1 < n else END)
        return start if n else END

    mini, mini_fat, entries = b"", [], []
    for name, data in streams.items():
        if len(data) < cutoff:
            start = len(mini) // 64
            n = -(-len(data) // 64)
            mini += data.ljust(n * 64, b"\0")
            mini_fat += [start + k + 1 if k + 1 < n else END for k in range(n)]
            entries.append((name, 2, start if n else END, len(data)))
        else:
            entries.append((name, 2, put(data), len(data)))
    mini_start = put(mini)
    table_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-max(1, len(mini_fat) * 4) // size) * size, b"\xff")) if mini_fat else END

    def entry(name, kind, start, length):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + struct.pack("<III", FREE, FREE, FREE) + b"\0" * 36 + struct.pack("<IQ", start, length)

    directory = entry("Root Entry", 5, mini_start, len(mini)) + b"".join(entry(*e) for e in entries)
    dir_start = put(directory.ljust(-(-len(directory) // size) * size, b"\0"))
    n_fat = 1
    while (len(fat) + n_fat) * 4 > n_fat * size:
        n_fat += 1
    fat_at = len(sectors)
    fat += [FAT] * n_fat
    raw = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * size, b"\xff")
    sectors += [raw[k * size : (k + 1) * size] for k in range(n_fat)]
    head = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 4 if shift == 12 else 3, 0xFFFE, shift, 6) + b"\0" * 6
    head += struct.pack("<III", 0, n_fat, dir_start) + struct.pack("<IIIIII", 0, cutoff, table_start, 1 if mini_fat else 0, END, 0)
    head += struct.pack("<109I", *([fat_at + k for k in range(n_fat)] + [FREE] * (109 - n_fat)))
    return b"".join([head.ljust(size, b"\0"), *sectors])


def sheet(records, **options):
    """A sheet's file; larger ones take larger sectors, so that the header's table of tables is enough."""
    data = stream(chain([{"HEADER": "Protel for Windows"}], records))
    return container({"FileHeader": data}, **({"shift": 12 if len(data) > 4 << 20 else 9} | options))
