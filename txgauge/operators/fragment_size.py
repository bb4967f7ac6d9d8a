"""Largest plausible distance between the mates of a pair, from the first pairs in read order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgauge.functions import alignment as A

PAIRS = 10_000


def _pairs(head: DataFrame) -> DataFrame:
    """(ord, size) of accepted pairs of neighbouring primary records with one name."""
    w = Window.orderBy("ord")  # over the head of the file only, see realistic_distance
    pos = F.when(A.has(F.col("flag"), A.UNMAPPED), -1).otherwise(F.col("pos"))
    d = head.select("ord", "qname", "flag", "next_pos", pos.alias("p"), F.col("query_len").alias("n"))
    d = d.withColumns({"q0": F.lag("qname").over(w), "p0": F.lag("p").over(w), "n0": F.lag("n").over(w)})
    d = d.filter((F.col("qname") == F.col("q0")) & (F.col("p") >= 0) & (F.col("p0") >= 0))
    rev, mate = A.has(F.col("flag"), A.REVERSE), A.has(F.col("flag"), A.MATE_REVERSE)
    away = (~rev & mate & (F.col("p") > F.col("next_pos"))) | (rev & ~mate & (F.col("next_pos") > F.col("p")))
    size = F.when(F.col("p") > F.col("p0"), F.col("p") - F.col("p0") + F.col("n")).otherwise(F.col("p0") - F.col("p") + F.col("n0"))
    return d.filter(~away).select("ord", size.cast("long").alias("size"))


def _recurrence(sizes: Column) -> Column:
    """int(3 sd + mean): the running mean divides by the pairs before it, the final mean is whole."""

    def step(z: Column, x: Column) -> Column:
        first = z["k"] == 0
        mean = F.when(first, x.cast("double")).otherwise(z["m"] + (x - z["m"]) / F.greatest(z["k"], F.lit(1)))
        s = F.when(first, z["s"]).otherwise(z["s"] + (x - z["m"]) * (x - mean))
        return F.struct((z["k"] + 1).alias("k"), mean.alias("m"), s.alias("s"), (z["t"] + x).alias("t"))

    zero = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("t"))
    sd = lambda z: F.when(z["k"] > 1, F.sqrt(z["s"] / F.greatest(z["k"] - 1, F.lit(1)))).otherwise(0.0)
    return F.aggregate(sizes, zero, step, lambda z: F.when(z["k"] > 0, 3 * sd(z) + F.floor(F.try_divide(z["t"], z["k"]))).otherwise(0.0).cast("long"))


def estimate(pairs: DataFrame, limit: int = PAIRS, faithful: bool = True) -> DataFrame:
    """realistic_distance, n_pairs from (ord, size): one row, 0 without pairs; at most `limit` pairs are used.

    With faithful off, mean + 3 sample standard deviations.
    """
    first = pairs.orderBy("ord").limit(limit)
    if not faithful:
        plain = F.floor(3 * F.coalesce(F.stddev_samp("size"), F.lit(0.0)) + F.avg("size")).cast("long")
        return first.agg(F.coalesce(plain, F.lit(0).cast("long")).alias("realistic_distance"), F.count(F.lit(1)).alias("n_pairs"))
    held = first.agg(F.array_sort(F.collect_list(F.struct("ord", "size"))).alias("a"))  # at most limit pairs
    return held.select(_recurrence(F.col("a")["size"]).alias("realistic_distance"), F.size("a").cast("long").alias("n_pairs"))


def first_pairs(alignments: DataFrame, limit: int = PAIRS) -> DataFrame:
    """(ord, size) of at least the first `limit` accepted pairs of alignments (ord, qname, flag, pos, query_len, next_pos).

    Only the head of the file is read: up to four records a pair wanted, and eight times as many whenever these do
    not hold enough pairs.
    """
    use = alignments.filter(~A.has(F.col("flag"), A.SECONDARY | A.SUPPLEMENTARY))
    last, reach = alignments.agg(F.max("ord")).first()[0], 4 * limit
    while True:
        pairs = _pairs(use.filter(F.col("ord") < reach))
        if last is None or reach > last or pairs.limit(limit).count() >= limit:
            return pairs
        reach *= 8


def realistic_distance(alignments: DataFrame, limit: int = PAIRS, faithful: bool = True) -> int:
    """The estimate over alignments, see first_pairs. A file sorted by place has no neighbouring mates and gives 0."""
    return estimate(first_pairs(alignments, limit), limit, faithful).first()["realistic_distance"]
