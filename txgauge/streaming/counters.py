"""Counters of assigned records kept up to date while files of records arrive.

Counters are sums of whole numbers, so a stream of files gives the same totals as one pass over all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txgauge.operators import accumulation


def stream_counters(spark: SparkSession, folder: str, schema: str, distance: int, name: str, checkpoint: str) -> StreamingQuery:
    """A query over the Parquet files that arrive in folder; the totals so far are the in-memory table `name`."""
    arrived = spark.readStream.schema(schema).parquet(folder)
    totals = accumulation.counters(arrived, distance)
    return totals.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_counters(*parts: DataFrame) -> DataFrame:
    """The sum of counter tables of separate parts of a run."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("ref_id").agg(*[F.sum(c).alias(c) for c in accumulation.COUNTERS])
