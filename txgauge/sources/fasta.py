"""FASTA files: plain ones by Spark's text reader, split anywhere at the start of a record; packed ones by a data source, one task a file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from txgauge.operators.assembly_stats import duplicate_names
from txgauge.session import numbered
from txgauge.sources.files import is_packed, open_text

_BATCH = 4096
_SCHEMA = "file string, contig_idx long, defline string, seq string"


def records(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(description line without >, sequence); what stands before the first > is ignored."""
    head, parts = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if line.startswith(">"):
            if head is not None:
                yield head, "".join(parts)
            head, parts = line[1:], []
        elif head is not None and (s := line.strip()):
            parts.append(s)
    if head is not None:
        yield head, "".join(parts)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str]] = []
        at = 0

        def batch() -> pa.RecordBatch:
            k = len(rows)
            return pa.record_batch({"file": pa.array([partition.path] * k), "contig_idx": pa.array(range(at, at + k), pa.int64()), "defline": pa.array([r[0] for r in rows]), "seq": pa.array([r[1] for r in rows])})

        size = 0
        with open_text(partition.path) as f:
            for r in records(f):
                rows.append(r)
                size += len(r[1])
                if len(rows) == _BATCH or size > 1 << 24:
                    yield batch()
                    at, rows, size = at + len(rows), [], 0
        if rows:
            yield batch()


class FastaSource(DataSource):
    """spark.read.format("fasta").load(path); the option paths takes several, one a line."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("paths", self.options.get("path", "")).split("\n"))


def parse_records(d: DataFrame) -> DataFrame:
    """d with defline and seq instead of value: a record's text behind its >, lines ended in any way, white space around them."""
    parts = F.split("value", "\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"[ \t\r]*(?:\n[ \t\r\n]*|$)", "")
    return d.select(*[c for c in d.columns if c != "value"], F.rtrim(parts[0], F.lit("\r")).alias("defline"), F.ltrim(seq).alias("seq"))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(file, contig_idx, defline, seq) of one file that is not packed, or of a folder of such files as one.

    What stands before the first > of a file is ignored.
    """
    # only a file's first piece still has its >; without one it is no record
    d = numbered(spark.read.option("lineSep", "\n>").text(path), "contig_idx", "__own", ~F.startswith("value", F.lit(">")))
    value = F.when(F.col("__own") == 0, F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    return parse_records(d.select(F.lit(path).alias("file"), "contig_idx", value.alias("value")))


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, contig_idx, defline, name, seq, length). name is the first word of defline without trailing semicolons.

    contig_idx counts from 0 in each file.
    """
    packed = [p for p in map(str, paths) if is_packed(p)]
    parts = [read_plain(spark, p) for p in map(str, paths) if p not in packed]
    if packed:
        spark.dataSource.register(FastaSource)
        parts.append(spark.read.format("fasta").option("paths", "\n".join(packed)).load())
    d = reduce(DataFrame.unionByName, parts)
    name = F.rtrim(F.regexp_extract("defline", r"\S+", 0), F.lit(";"))
    seq = F.translate("seq", "\0", "")
    return d.select("file", "contig_idx", "defline", name.alias("name"), seq.alias("seq"), F.length(seq).alias("length"))


def check_contigs(contigs: DataFrame) -> None:
    """Raise if a sequence is empty, or a name has a comma or occurs twice."""
    odd = contigs.select("name", F.when(F.length("seq") == 0, "has no sequence").when(F.contains("name", F.lit(",")), "has a comma in its name").alias("why"))
    for r in odd.filter("why is not null").take(1):
        raise ValueError(f"contig {r['name']!r} {r['why']}")
    for r in duplicate_names(contigs).take(1):
        raise ValueError(f"contig {r['name']!r} occurs {r['n']} times")


def load_assembly(spark: SparkSession, path: str) -> DataFrame:
    """(contig_idx, name, seq, length), checked."""
    contigs = read_fasta(spark, path).select("contig_idx", "name", "seq", "length")
    check_contigs(contigs)
    return contigs


def count_contigs(path: str) -> int:
    with open_text(path) as f:
        return sum(line.startswith(">") for line in f)


def with_archive_names(contigs: DataFrame) -> DataFrame:
    """contigs with name by archive_name of their defline; raises if that makes two alike."""
    d = contigs.withColumn("name", archive_name(F.col("defline")))
    for r in duplicate_names(d).take(1):
        raise ValueError(f"contigs would have the name {r['name']!r} {r['n']} times")
    return d


def archive_name(defline):
    """Column: the middle part of an ENA|..|.. identifier; other pipes become underscores."""
    word = F.regexp_extract(defline, r"\S+", 0)
    parts = F.split(word, r"\|")
    return F.when((F.size(parts) >= 3) & (parts[0] == "ENA"), parts[1]).otherwise(F.translate(word, "|", "_"))
