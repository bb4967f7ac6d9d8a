"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run of these characters is white space to every operator here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: White-space runs other than one single space: what replacing runs by a space changes.
_RUN = rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def one_spaced(text: Column) -> Column:
    """The text with every white-space run replaced by one space; null counts as empty."""
    return F.regexp_replace(filled(text), _RUN, " ")


def others(df: DataFrame, added: Iterable[str]) -> list[str]:
    """The columns of df that are not named like an added one; Spark does not tell names apart by case."""
    names = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in names]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """batch in consecutive slices, without copies, each with about `most` bytes of a text column or a single longer text."""
    if batch.num_rows:
        sums = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.flatnonzero(np.diff(sums // most, prepend=-1)).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def _trim() -> None:
    """Give memory that is not used any more back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def from_texts(docs: DataFrame, text: Column, columns: Sequence[str], made: str, start: Callable[[], Callable[[list[str | None]], list[pa.Array]]]) -> DataFrame:
    """The columns of docs and those of the schema `made`: start(), once a task, gives what makes them of some MB of texts."""
    d = docs.select(*columns, text.cast("string").alias("__of_text"))
    new = T.StructType.fromDDL(made)
    names, schema = [*columns, *new.names], T.StructType([*d.schema.fields[:-1], *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            for part in slices(b, "__of_text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *make(part.column("__of_text").to_pylist())], names=names)
        _trim()

    return d.mapInArrow(run, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: the session's spark.checkpoint.dir. Only a local session may do without one.

    Where none is set, a local session (tests) takes a temporary folder; on a cluster machines would not see each
    other's, so that raises.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's checkpoint folder, its lineage cut there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as Parquet in the cluster's checkpoint folder, read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and let Spark drop the shuffles that led to them."""
    for t in tables:
        for path in {os.path.dirname(f).split("/batch=")[0] for f in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()
