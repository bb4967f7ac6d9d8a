"""BAM files as a data source: one task a file, in read order.

A record is decoded once, into the columns that the operators use; write the result as Parquet and everything after
runs in parallel, with columns and row groups pruned. Records whose CIGAR does not fit their sequence are left out and
counted; a hundred in a row, or a file that ends early, is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: the empty block at the end of a complete file
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
# fixed values: bytes of an auxiliary value by its type
_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
_WHOLE = {b"c": "<b", b"C": "<B", b"s": "<h", b"S": "<H", b"i": "<i", b"I": "<I"}
BAD_IN_A_ROW, _BATCH = 100, 20_000
_CORE = struct.Struct("<iiBBHHHiiii")
SCHEMA = (
    "ord long, fragment_idx long, qname string, flag int, ref_id int, pos int, cigar array<struct<op: int, len: int>>, "
    "query_len int, next_ref_id int, next_pos int, nm int, skipped long"
)


class MalformedBam(ValueError):
    """The file is truncated or damaged."""


def is_complete(path: str | Path) -> bool:
    """Whether the file ends with the empty block that closes a BAM."""
    p = Path(path)
    if not p.is_file() or p.stat().st_size < len(END):
        return False
    with p.open("rb") as f:
        f.seek(-len(END), 2)
        return f.read() == END


class Blocks:
    """Bytes of a BGZF file, read in order."""

    def __init__(self, f: IO[bytes]) -> None:
        self.f, self.held, self.at = f, b"", 0

    def _block(self) -> bytes | None:
        head = self.f.read(12)
        if not head:
            return None
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise MalformedBam("not a BGZF block")
        extra = self.f.read(struct.unpack_from("<H", head, 10)[0])
        i, size = 0, None
        while i + 4 <= len(extra):
            tag, n = extra[i : i + 2], struct.unpack_from("<H", extra, i + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        if size is None:
            raise MalformedBam("a block without its size")
        body = self.f.read(size - 12 - len(extra))
        if len(body) < size - 12 - len(extra):
            raise MalformedBam("the file ends within a block")
        return zlib.decompress(body[:-8], -15)

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer only at the end of the file."""
        if self.at + n > len(self.held):
            parts, have = [self.held[self.at :]], len(self.held) - self.at
            while have < n and (b := self._block()) is not None:
                parts.append(b)
                have += len(b)
            self.held, self.at = b"".join(parts), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def exactly(self, n: int) -> bytes:
        out = self.take(n)
        if len(out) < n:
            raise MalformedBam("the file ends within a record")
        return out


def read_header(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the references."""
    if blocks.exactly(4) != b"BAM\1":
        raise MalformedBam("not a BAM file")
    blocks.exactly(struct.unpack("<i", blocks.exactly(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.exactly(4))[0]):
        name = blocks.exactly(struct.unpack("<i", blocks.exactly(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.exactly(4))[0]))
    return out


def header(path: str | Path) -> list[tuple[str, int]]:
    with open(path, "rb") as f:
        return read_header(Blocks(f))


def edit_distance(b: bytes, at: int) -> int | None:
    """The NM value among the auxiliary fields that begin at a place."""
    while at + 3 <= len(b):
        tag, kind = b[at : at + 2], b[at + 2 : at + 3]
        at += 3
        if tag == b"NM" and kind in _WHOLE:
            return struct.unpack_from(_WHOLE[kind], b, at)[0]
        if kind in (b"Z", b"H"):
            at = b.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + _SIZES[b[at : at + 1]] * struct.unpack_from("<i", b, at + 1)[0]
        else:
            at += _SIZES[kind]
    return None


# by operation: does it consume the query; and also counting hard clips, as for the length of the read
_QUERY = np.array([1, 1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_READ = np.array([1, 1, 0, 0, 1, 1, 0, 1, 1, 0, 0, 0, 0, 0, 0, 0])


def decoded(blocks: Blocks, batch: int = _BATCH) -> Iterator[pa.RecordBatch]:
    """Records after the header, in batches; skipped is how many were left out so far."""
    rows: list[tuple] = []
    ops: list[np.ndarray] = []
    order, fragment, name, skipped, bad = 0, -1, None, 0, 0

    def flush() -> pa.RecordBatch:
        sizes = np.array([len(o) for o in ops], np.int32)
        flat = np.concatenate(ops) if ops else np.zeros(0, np.uint32)
        pairs = pa.StructArray.from_arrays([pa.array((flat & 15).astype(np.int32)), pa.array((flat >> 4).astype(np.int32))], ["op", "len"])
        cigar = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pairs)
        c = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ("ord", "fragment_idx", "qname", "flag", "ref_id", "pos", "query_len", "next_ref_id", "next_pos", "nm", "skipped")
        made = {n: pa.array(x, k) for n, x, k in zip(names, c, kinds, strict=True)}
        made["cigar"] = cigar
        return pa.record_batch({n: made[n] for n in (*names[:6], "cigar", *names[6:])})

    while size := blocks.take(4):
        if len(size) < 4:
            raise MalformedBam("the file ends within a record")
        b = blocks.exactly(struct.unpack("<i", size)[0])
        ref, pos, n_name, _, _, n_ops, flag, n_seq, next_ref, next_pos, _ = _CORE.unpack_from(b)
        at = _CORE.size + n_name
        o = np.frombuffer(b, "<u4", n_ops, at)
        kind, length = o & 15, o >> 4
        if n_ops and n_seq > 0 and not flag & 4 and int((_QUERY[kind] * length).sum()) != n_seq:
            skipped, bad = skipped + 1, bad + 1
            if bad >= BAD_IN_A_ROW:
                raise MalformedBam(f"{bad} records in a row have a CIGAR that does not fit their sequence")
            continue
        bad = 0
        q = b[_CORE.size : at - 1].decode()
        if q != name:
            name, fragment = q, fragment + 1
        read = n_seq or int((_READ[kind] * length).sum())
        nm = edit_distance(b, at + 4 * n_ops + (n_seq + 1) // 2 + n_seq)
        rows.append((order, fragment, q, flag, ref, pos, read, next_ref, next_pos, nm, skipped))
        ops.append(o)
        order += 1
        if len(rows) == batch:
            yield flush()
            rows, ops = [], []
    if rows:
        yield flush()


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            blocks = Blocks(f)
            read_header(blocks)
            yield from decoded(blocks)


class BamSource(DataSource):
    """spark.read.format("bam").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(str(path))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, name, length) in the header's order."""
    return spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(header(path))], "ref_id int, name string, length int")


def to_parquet(spark: SparkSession, path: str, to: str) -> tuple[DataFrame, DataFrame]:
    """(alignments, references), the alignments decoded once and written."""
    read_bam(spark, path).write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).parquet(to)
    return spark.read.parquet(to), read_references(spark, path)
