"""Depth of coverage as runs, never as one row a base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txgauge.functions import alignment as A
from txgauge.functions import bins as B
from txgauge.session import small


def blocks(assigned: DataFrame, refs: DataFrame, n_refs: int) -> DataFrame:
    """(ref_id, start, end) of the reference blocks that the mapped records cover; refs: ref_id, length, n_refs of them."""
    m = assigned.filter(~A.has(F.col("flag"), A.UNMAPPED)).select("ref_id", "pos", "cigar")
    d = m.join(small(refs.select("ref_id", F.col("length").alias("__length")), n_refs), "ref_id")
    b = d.select("ref_id", F.explode(A.covered_blocks(F.col("pos"), F.col("cigar"), F.col("__length"))).alias("b"))
    return b.select("ref_id", "b.start", "b.end").filter("end > start")


def runs(covered: DataFrame) -> DataFrame:
    """(ref_id, start, end, depth) of maximal stretches between block borders with depth over 0.

    Borders are summed by position first, so a contig has at most two rows a base however deep it is covered.
    """
    borders = covered.select("ref_id", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    borders = borders.groupBy("ref_id", "x.pos").agg(F.sum("x.d").alias("d")).filter("d <> 0")
    w = Window.partitionBy("ref_id").orderBy("pos")
    r = borders.select("ref_id", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w).alias("depth"))
    return r.filter("depth > 0")


def bases_uncovered(refs: DataFrame, covered_runs: DataFrame) -> DataFrame:
    """(ref_id, bases_uncovered) of every reference."""
    on = covered_runs.groupBy("ref_id").agg(F.sum(F.col("end") - F.col("start")).alias("__covered"))
    return refs.join(on, "ref_id", "left").select("ref_id", (F.col("length") - F.coalesce("__covered", F.lit(0))).cast("long").alias("bases_uncovered"))


def bin_states(refs: DataFrame, covered_runs: DataFrame, bins: int = B.BINS, pad: bool = True) -> DataFrame:
    """(ref_id, bin, state): the state of each bin's mean depth.

    Runs go to the bins they overlap. With pad there are always `bins` bins, those past the end having state 0.
    """
    w = refs.select("ref_id", "length", B.bin_width(F.col("length"), bins).alias("__w"))
    parts = covered_runs.join(w, "ref_id").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / F.col("__w")), F.floor((F.col("end") - 1) / F.col("__w")))))
    low = F.greatest(F.col("start"), F.col("bin") * F.col("__w"))
    high = F.least(F.col("end"), (F.col("bin") + 1) * F.col("__w"))
    sums = parts.groupBy("ref_id", "bin").agg(F.sum((high - low) * F.col("depth")).alias("total"))
    totals = sums.groupBy("ref_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "total"))).alias("__totals"))  # at most `bins` entries
    every = w.join(totals, "ref_id", "left").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    size = B.bin_size(F.col("length"), F.col("__w"), F.col("bin"))
    every = every if pad else every.filter(size > 0)
    total = F.coalesce(F.try_element_at("__totals", F.col("bin")), F.lit(0))
    return every.select("ref_id", F.col("bin").cast("int").alias("bin"), B.state_of(total, size).alias("state"))
