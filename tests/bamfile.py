"""A small BAM writer for tests."""

from __future__ import annotations

import re
import struct
import zlib

OPS = "MIDNSHP=X"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def cigar(text):
    return [(OPS.index(o), int(n)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]


def record(name, flag=0, ref=0, pos=0, cig="100M", nref=-1, npos=-1, nm=0, n_seq=None, extra=b""):
    ops = cigar(cig)
    n = sum(k for o, k in ops if o in (0, 1, 4, 7, 8)) if n_seq is None else n_seq
    aux = extra + (b"" if nm is None else b"NMC" + bytes([nm]))
    q = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(q), 60, 0, len(ops), flag, n, nref, npos, 0) + q
    body += b"".join(struct.pack("<I", k << 4 | o) for o, k in ops) + b"\x11" * ((n + 1) // 2) + b"\xff" * n + aux
    return struct.pack("<i", len(body)) + body


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write(path, refs, records, size=700, end=True):
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for name, length in refs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    data += b"".join(records)
    with open(path, "wb") as f:
        for i in range(0, len(data), size):  # records span blocks
            f.write(block(data[i : i + size]))
        f.write(END if end else b"")
    return str(path)


def pair(name, ref=0, start=10, gap=50, cig="50M", cig2=None, nm=0, extra_flag=0):
    """Read 1 forward and read 2 reverse, properly paired on one reference."""
    return [
        record(name, 1 | 2 | 32 | 64 | extra_flag, ref, start, cig, ref, start + gap, nm),
        record(name, 1 | 2 | 16 | 128 | extra_flag, ref, start + gap, cig2 or cig, ref, start, nm),
    ]
