"""Assignment of every fragment to its most probable contig.

Alignments: ord, fragment_idx, flag, ref_id, query_len, nm and more columns that are carried along. References: ref_id,
name. Expression: name, eff_count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txgauge.functions import alignment as A
from txgauge.session import small


def prior_table(refs: DataFrame, expression: DataFrame | None = None) -> DataFrame:
    """ref_id, name, prior and log_prior of every reference; names that are not in expression have the pseudocount.

    The last of several expression rows of a name would win in file order, so names should be distinct there.
    """
    if expression is None:
        counts = refs.withColumn("eff_count", F.lit(0.0))
    else:
        counts = refs.join(expression.select("name", F.col("eff_count").cast("double")), "name", "left")
    p = counts.select("ref_id", "name", A.prior(F.col("eff_count")).alias("prior"))
    return p.withColumn("log_prior", F.log("prior"))


def _mapped(alignments: DataFrame, error_rate: float) -> DataFrame:
    m = alignments.filter(~A.has(F.col("flag"), A.UNMAPPED))
    return m.withColumns({"__ll": A.log_likelihood(F.col("nm"), F.col("query_len"), error_rate), "__bit": F.when(A.has(F.col("flag"), A.READ2), 2).otherwise(1)})


def _scored(df: DataFrame, error_rate: float, fraction: float):
    missing = F.bit_count("__mates") - F.bit_count("__own")
    charge = F.when(missing > 0, A.orphan_cost(F.col("__typical"), error_rate, fraction) * missing).otherwise(0.0)
    return df.withColumn("score", F.col("log_prior") + F.col("__sum") + charge)


def candidates(
    alignments: DataFrame, priors: DataFrame, n_refs: int, error_rate: float = A.ERROR_RATE, fraction: float = A.ORPHAN_FRACTION
) -> DataFrame:
    """(fragment_idx, ref_id, name, prior, score) of every contig a fragment could come from.

    A mate that another candidate explains and this one does not is charged as a bad alignment of the longest read.
    """
    each = _mapped(alignments, error_rate).groupBy("fragment_idx", "ref_id").agg(F.sum("__ll").alias("__sum"), F.bit_or("__bit").alias("__own"), F.max("query_len").alias("__longest"))
    f = Window.partitionBy("fragment_idx")
    each = each.withColumns({"__mates": F.bit_or("__own").over(f), "__typical": F.max("__longest").over(f)})
    return _scored(each.join(small(priors, n_refs), "ref_id"), error_rate, fraction).select("fragment_idx", "ref_id", "name", "prior", "score")


def assign(
    alignments: DataFrame,
    priors: DataFrame,
    n_refs: int,
    error_rate: float = A.ERROR_RATE,
    fraction: float = A.ORPHAN_FRACTION,
    clear_secondary: bool = True,
    places: int | None = None,
) -> DataFrame:
    """The mapped records of each fragment that lie on its best contig: highest score, then prior, then least name.

    Scores are sums of doubles in record order. places rounds scores before they are ranked. All windows share one
    exchange on fragment_idx; there is no join back to the records.
    """
    m = _mapped(alignments, error_rate).join(small(priors.withColumnRenamed("name", "__name"), n_refs), "ref_id")
    own = Window.partitionBy("fragment_idx", "ref_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    f = Window.partitionBy("fragment_idx")
    m = m.repartition(F.col("fragment_idx")).withColumns({"__sum": F.sum("__ll").over(own), "__own": F.bit_or("__bit").over(own)})
    # __mates is taken from __own, so that the wider window stays above and one sort serves both windows
    m = m.withColumns({"__mates": F.bit_or("__own").over(f), "__typical": F.max("query_len").over(f)})
    m = _scored(m, error_rate, fraction)
    rank = F.col("score") if places is None else F.round("score", places)
    best = F.min(F.struct((-rank).alias("s"), (-F.col("prior")).alias("p"), F.col("__name").alias("n"), F.col("ref_id").alias("r"))).over(f)
    kept = m.withColumn("__best", best).filter(F.col("ref_id") == F.col("__best.r"))
    flag = F.col("flag").bitwiseAND(~A.SECONDARY) if clear_secondary else F.col("flag")
    return kept.select(*[flag.alias("flag") if c == "flag" else c for c in alignments.columns])
