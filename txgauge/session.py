"""A session with the settings the plans are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Rows up to which a side of a join is broadcast after its rows were counted.
BROADCAST_ROWS = 200_000


def session(master: str | None = None, name: str = "txgauge", **more: str) -> SparkSession:
    """A session with SETTINGS; more takes settings with underscores for dots."""
    b = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (b.master(master) if master else b).getOrCreate()


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its known number of rows is small, else as it is: Spark then sorts or splits skew."""
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """df dealt over all cores if Spark's statistics say it is small: one file of a few MB is one task otherwise.

    The bound is in bytes, whatever the number of cores, so no large scan is ever shuffled by this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else df


def dealt(df: DataFrame, rows: int, *by: str, most: int = 400_000) -> DataFrame:
    """df, known to have so many rows, with equal values of by together, in as many partitions as keep about most rows each.

    The number of shuffle partitions of a session does not grow with the input, and small ones are coalesced by their
    packed bytes; so tasks would hold more rows the larger the input is.
    """
    return df.repartition(min(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), 1 << 15), *by)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, spark.checkpoint.dir; only a local session may do without, in a temporary one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return named or f"file://{tempfile.gettempdir()}/checkpoints"


def numbered(df: DataFrame, name: str, own: str | None = None, unless: Column | None = None) -> DataFrame:
    """df, scanned from files, with the number of each row from 0 in the order of the file; of a folder, files follow by path.

    Rows are counted by block of a file; a block's rows are numbered by what stands before it. The table of blocks
    has a row for each split. own names a column for the number in the row's own file. A file's first row is left out
    and not counted if it fulfils unless.
    """
    odd = F.lit(False) if unless is None else unless
    d = df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__at": F.monotonically_increasing_id()})
    sizes = d.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"), F.min_by(odd, "__at").alias("odd")).orderBy("__file", "__block").collect()
    starts, before, inside, last = [], 0, 0, None
    for r in sizes:
        if r["__file"] != last:
            last, inside = r["__file"], 0
        before -= inside == 0 and r["odd"]
        starts.append((r["__file"], r["__block"], r["first"], before, inside))
        before, inside = before + r["n"], inside + r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "__f string, __b long, __first long, __before long, __inside long")
    d = d.join(F.broadcast(offsets), (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    at = F.col("__at") - F.col("__first")
    if unless is not None:
        d = d.filter((at + F.col("__inside") > 0) | ~odd)
    return d.select(*df.columns, (at + F.col("__before")).alias(name), *([(at + F.col("__inside")).alias(own)] if own else []))
