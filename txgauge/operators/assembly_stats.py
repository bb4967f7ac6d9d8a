"""Length, reading-frame and composition statistics of assemblies.

Contigs come as (contig_idx, name, seq, length); more columns are ignored. With `by`, there is a row for each value of
those columns, so many assemblies are one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txgauge.functions import sequence

SHORT, LONG, VERY_LONG, ORF_CODONS = 200, 1_000, 10_000, 149
NX = (90, 70, 50, 30, 10)
BASIC = ("n_seqs", "smallest", "largest", "n_bases", "mean_len", "n_under_200", "n_over_1k", "n_over_10k", "n_with_orf", "mean_orf_percent")
COMPOSITION = ("gc", "bases_n", "proportion_n")


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def sequence_columns(contigs: DataFrame) -> DataFrame:
    """contigs with prop_gc and orf_length."""
    return contigs.withColumns({"prop_gc": sequence.prop_gc(F.col("seq")), "orf_length": sequence.longest_orf(F.col("seq"))})


def basic_stats(contigs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of BASIC from contigs with length and orf_length.

    Contigs under 200 bases count in n_seqs, smallest, largest and n_bases only; mean_len divides the bases of the
    others by the number of all.
    """
    n = F.col("length")
    fit = n >= SHORT
    t = contigs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seqs"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("smallest"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("largest"),
        _sum(n).alias("n_bases"),
        _sum(F.when(fit, n)).alias("__bases"),
        F.count_if(n < SHORT).alias("n_under_200"),
        F.count_if(n > LONG).alias("n_over_1k"),
        F.count_if(n > VERY_LONG).alias("n_over_10k"),
        F.count_if(fit & (F.col("orf_length") > ORF_CODONS)).alias("n_with_orf"),
        _sum(F.when(fit, F.col("orf_length"))).alias("__orf"),
    )
    t = t.withColumn("mean_len", _zero(F.try_divide(F.col("__bases").cast("double"), F.col("n_seqs"))))
    t = t.withColumn("mean_orf_percent", _zero(F.try_divide(300.0 * F.col("__orf"), F.col("n_seqs") * F.col("mean_len"))))
    return t.select(*by, *BASIC)


def nx(contigs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row of n90, n70, n50, n30 and n10.

    Contigs of at least 200 bases are walked from the shortest; each may reach one threshold (a share of all bases,
    short contigs included), and thresholds that are not reached take the longest contig of all. In closed form: with
    f_j the first rank whose running sum reaches threshold j, the k-th value stands at rank max over j <= k of
    f_j + (k - j). The running sums go over distinct lengths, not contigs, so their single sort stays small.
    """
    sizes = contigs.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy(*by).agg(F.sum(F.col("length") * F.col("n")).alias("bases"), F.max("length").cast("long").alias("largest"))
    up = Window.partitionBy(*by).orderBy("length")
    fit = sizes.filter(F.col("length") >= SHORT)
    fit = fit.withColumn("upto", F.sum("n").over(up)).withColumn("sum", F.sum(F.col("length") * F.col("n")).over(up))
    d = fit.join(whole, list(by)) if by else fit.crossJoin(F.broadcast(whole))  # one row

    def rank(p: int) -> Column:
        """First rank within a length's contigs that reaches the threshold, if it is there."""
        goal = F.col("bases") * F.lit((100 - p) / 100.0)
        before = F.col("sum") - F.col("length") * F.col("n")
        return F.min(F.when(F.col("sum") >= goal, F.col("upto") - F.col("n") + F.greatest(F.ceil((goal - before) / F.col("length")), F.lit(1))))

    # thresholds rise as the labels fall: N90 is reached at a tenth of all bases
    firsts = d.groupBy(*by).agg(
        *[rank(p).alias(f"f{j}") for j, p in enumerate(NX)],
        F.max("upto").alias("m"),
        F.array_sort(F.collect_list(F.struct("upto", F.col("length").cast("long").alias("length")))).alias("steps"),
    )
    all_ = whole.join(firsts, list(by), "left") if by else whole.crossJoin(F.broadcast(firsts))  # one row

    def length_at(rank_: Column) -> Column:
        return F.get(F.filter("steps", lambda s: s["upto"] >= rank_), F.lit(0))["length"]

    out = []
    for k, p in enumerate(NX):
        ranks = [F.col(f"f{j}") + (k - j) for j in range(k + 1)]
        reached = F.greatest(*ranks) if k else ranks[0]
        for r in ranks:
            reached = F.when(r.isNotNull(), reached)
        out.append(F.coalesce(F.when(reached <= F.col("m"), length_at(reached)), F.col("largest"), F.lit(0).cast("long")).alias(f"n{p}"))
    return all_.select(*by, *out)


def base_stats(contigs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """gc (of a, c, g and t), bases_n and proportion_n (of all), one row."""
    c = sequence.composition(F.col("seq"))
    t = contigs.select(*by, F.length("seq").alias("n"), (c["g"] + c["c"]).alias("gc"), c["n"].alias("other"))
    t = t.groupBy(*by).agg(_sum(F.col("n")).alias("n"), _sum(F.col("gc")).alias("gc"), _sum(F.col("other")).alias("bases_n"))
    gc = _zero(F.try_divide(F.col("gc").cast("double"), F.col("n") - F.col("bases_n")))
    return t.select(*by, gc.alias("gc"), "bases_n", _zero(F.try_divide(F.col("bases_n").cast("double"), F.col("n"))).alias("proportion_n"))


def duplicate_names(contigs: DataFrame) -> DataFrame:
    """name, n of names that occur more than once."""
    return contigs.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
