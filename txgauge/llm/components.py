"""Connected components of a graph held as a table of edges, on the executors only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txgauge.llm.common import cut, release

ONE_TASK = 1 << 17  # edges that one task solves: affects speed and disk only


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of the graph that all batches of (hi, lo) make together."""
    parts = list(batches)
    if not parts:
        return
    d = pd.concat(parts, ignore_index=True)
    nodes, at = np.unique(np.concatenate([d["hi"].to_numpy(), d["lo"].to_numpy()]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in zip(at[: len(d)].tolist(), at[len(d) :].tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)  # nodes are in order, so a component's root is its smallest
    yield pd.DataFrame({"node": nodes, "root": nodes[[find(i) for i in range(len(nodes))]]})


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 200, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node of an edge between two nodes; root is the smallest node reachable.

    Alternating large-star and small-star steps until the edges no longer change: the table stays no larger than the
    input, and the number of rounds grows with the logarithm of the longest chain. Once at most `one_task` edges are
    left, one task does the rest: a round's exchanges have files for each partition, which a small graph does not need.
    A round's shuffles are let go before the next one. Nulls and loops are no edges.
    """
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo"))).distinct()
    e, last = cut(e), None
    for _ in range(most_rounds):
        state = tuple(e.agg(F.count(F.lit(1)), F.expr("coalesce(bit_xor(xxhash64(hi, lo)), 0)")).first())
        if state == last:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo"), F.col("lo")).distinct())
        if state[0] <= one_task:
            kind = e.schema["hi"].dataType
            return e.coalesce(1).mapInPandas(_roots, T.StructType().add("node", kind).add("root", kind)).repartition("node")
        last = state
        both = e.union(e.select("lo", "hi")).toDF("n", "v")
        least = both.groupBy("n").agg(F.least(F.min("v"), F.first("n")).alias("m"))
        large = both.filter("v > n").join(least, "n").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi").select("hi", "lo", "m")
        e = cut(small.select("hi", F.col("m").alias("lo")).union(small.filter("lo > m").select("lo", "m")).distinct())
        del both, least, large, root, small
        release(e.sparkSession)
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
