"""Counters of every reference over the records assigned to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgauge.functions import alignment as A

COUNTERS = (
    "reads_mapped", "bases_mapped", "fragments_mapped", "both_mapped", "properpair", "bridges", "good",
    "clipped_alignments", "clipped_bases", "leading_clipped_bases", "scored_alignments", "edit_distance_total",
)


def counters(assigned: DataFrame, distance: int) -> DataFrame:
    """ref_id and COUNTERS; whole numbers only, so the result does not depend on how the records are spread.

    The sums are taken on the map side first: a contig with a third of all records is one row of each task.
    """
    flag, ref, nxt, pos, mate = (F.col(c) for c in ("flag", "ref_id", "next_ref_id", "pos", "next_pos"))
    clip = A.clipped_bases(F.col("cigar"))
    pair = A.counts_pair(flag)
    scored = (F.col("query_len") > 0) & F.col("nm").isNotNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    named = {
        "reads_mapped": F.count(F.lit(1)),
        "bases_mapped": total(F.col("query_len")),
        "fragments_mapped": F.count_if(A.counts_fragment(flag)),
        "both_mapped": F.count_if(pair),
        "properpair": F.count_if(pair & A.has(flag, A.PROPER)),
        "bridges": F.count_if(A.is_bridge(flag, ref, nxt)),
        "good": F.count_if(A.is_good(flag, ref, nxt, pos, mate, distance)),
        "clipped_alignments": F.count_if(F.col("__clip") > 0),
        "clipped_bases": total(F.col("__clip")),
        "leading_clipped_bases": total(F.col("__lead")),
        "scored_alignments": F.count_if(scored),
        "edit_distance_total": total(F.when(scored, F.col("nm"))),
    }
    m = assigned.filter(~A.has(flag, A.UNMAPPED)).withColumns({"__clip": clip, "__lead": A.leading_clipped_bases(F.col("cigar"))})
    return m.groupBy("ref_id").agg(*[named[c].alias(c) for c in COUNTERS])


def over_references(refs: DataFrame, counted: DataFrame) -> DataFrame:
    """refs with COUNTERS, zeros for those without records."""
    joined = refs.join(counted, "ref_id", "left")
    return joined.select(*refs.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def clip_summary(accumulated: DataFrame) -> DataFrame:
    """alignments, clipped_alignments, clipped_bases, leading_clipped_bases, percent clipped and mean clips: one row."""
    t = accumulated.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("reads_mapped", "alignments"), *[(x, x) for x in ("clipped_alignments", "clipped_bases", "leading_clipped_bases")])]
    )
    zero = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return t.withColumns({
        "percent_clipped": 100 * zero("clipped_alignments", "alignments"),
        "mean_clip": zero("clipped_bases", "clipped_alignments"),
        "mean_leading_clip": zero("leading_clipped_bases", "clipped_alignments"),
    })
