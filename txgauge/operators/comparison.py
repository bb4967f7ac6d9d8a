"""Comparison of two runs over one assembly.

Runs are given as their written tables: assemblies (one row, text values) and contigs (contig_name and values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txgauge.functions.values import verdict
from txgauge.operators.assembly_stats import BASIC, COMPOSITION, NX
from txgauge.session import small

SEQUENCE_KEYS = (*BASIC, *(f"n{p}" for p in NX), *COMPOSITION)
CONTIG_SEQUENCE_KEYS = ("length", "prop_gc", "orf_length")
ASSEMBLY_METRICS = (
    "score", "optimal_score", "cutoff", "fragments", "fragments_mapped", "p_fragments_mapped", "good_mappings", "p_good_mapping",
    "bad_mappings", "potential_bridges", "bases_uncovered", "p_bases_uncovered", "contigs_uncovbase", "contigs_uncovered",
    "contigs_lowcovered", "contigs_segmented",
)
CONTIG_METRICS = ("score", "sCnuc", "sCcov", "sCord", "sCseg", "coverage", "tpm")
CHANGE, UNEXPLAINED = 1e-6, 0.02


def unpivoted(row: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(metric, value) of the named columns, as text; absent columns are left out."""
    have = [k for k in keys if k in row.columns]
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("string").alias(value)) for k in have])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def assembly_validity(base: DataFrame, other: DataFrame, keys: Sequence[str] = SEQUENCE_KEYS) -> DataFrame:
    """(metric, base, other, verdict) of what depends on the sequences alone; metrics that base lacks are left out."""
    b, o = unpivoted(base, keys, "base"), unpivoted(other, keys, "other")
    return b.join(F.broadcast(o), "metric", "left").withColumn("verdict", verdict(F.col("base"), F.col("other")))  # o: len(keys) rows


def contig_validity(base: DataFrame, other: DataFrame, keys: Sequence[str] = CONTIG_SEQUENCE_KEYS) -> DataFrame:
    """(metric, n, differing, worst): contigs of both runs, and for the metric contig_set those of one run only."""
    b = base.select("contig_name", *[F.col(k).cast("string").alias(f"b_{k}") for k in keys], F.lit(1).alias("__b"))
    o = other.select("contig_name", *[F.col(k).cast("string").alias(f"o_{k}") for k in keys], F.lit(1).alias("__o"))
    d = b.join(o, "contig_name", "full")
    both = F.col("__b").isNotNull() & F.col("__o").isNotNull()
    rows = []
    for k in keys:
        left, right = F.col(f"b_{k}"), F.col(f"o_{k}")
        apart = F.abs(left.try_cast("double") - right.try_cast("double"))
        rows.append(F.struct(F.lit(k).alias("metric"), F.count_if(both).alias("n"), F.count_if(both & (verdict(left, right) == "differs")).alias("differing"), F.coalesce(F.max(F.when(both, apart)), F.lit(0.0)).alias("worst")))
    rows.append(F.struct(F.lit("contig_set").alias("metric"), F.count_if(both).alias("n"), F.count_if(~both).alias("differing"), F.lit(0.0).alias("worst")))
    return d.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def is_valid(assemblies: DataFrame, contigs: DataFrame) -> DataFrame:
    """valid, one row, from the two tables above."""
    a = assemblies.agg(F.coalesce(F.bool_and(F.col("verdict") != "differs"), F.lit(True)).alias("a"))
    c = contigs.agg(F.coalesce(F.bool_and(F.col("differing") == 0), F.lit(True)).alias("c"))
    return a.crossJoin(F.broadcast(c)).select((F.col("a") & F.col("c")).alias("valid"))  # one row each


def metric_deltas(base: DataFrame, other: DataFrame, replicate: DataFrame | None = None, keys: Sequence[str] = ASSEMBLY_METRICS) -> DataFrame:
    """(metric, base, other, delta, noise, times_noise): with a replicate, |delta| over the replicate's.

    times_noise is infinite where only the noise is 0, and 0 where both are.
    """
    d = unpivoted(base, keys, "base").join(F.broadcast(unpivoted(other, keys, "other")), "metric")
    if replicate is not None:
        d = d.join(F.broadcast(unpivoted(replicate, keys, "again")), "metric")
    else:
        d = d.withColumn("again", F.lit(None).cast("string"))
    d = d.select("metric", *[F.col(c).try_cast("double").alias(c) for c in ("base", "other", "again")])
    d = d.withColumns({"delta": F.col("other") - F.col("base"), "noise": F.abs(F.col("again") - F.col("base"))})
    times = F.when(F.col("noise") > 0, F.abs("delta") / F.when(F.col("noise") > 0, F.col("noise"))).when(F.abs("delta") > 0, float("inf")).otherwise(0.0)
    return d.select("metric", "base", "other", "delta", "noise", F.when(F.col("noise").isNotNull(), times).alias("times_noise"))


def good_rate(row: DataFrame) -> Column:
    """p_good_mapping if it is there and not 0, else good over fragments; null if neither is known."""
    said = row["p_good_mapping"].try_cast("double")
    return F.when(said != 0, said).otherwise(F.try_divide(row["good_mappings"].try_cast("double"), row["fragments"].try_cast("double")))


def decomposition(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: score, rate and geometric mean of both runs, and what of the delta comes from rate and from contigs."""
    cols = lambda d, p: d.select(d["score"].try_cast("double").alias(f"{p}_score"), good_rate(d).alias(f"{p}_rate"))
    d = cols(base, "base").crossJoin(F.broadcast(cols(other, "other")))  # one row each
    d = d.withColumns({f"{p}_geomean": F.try_divide(F.col(f"{p}_score"), F.col(f"{p}_rate")) for p in ("base", "other")})
    d = d.withColumns({
        "total": F.col("other_score") - F.col("base_score"),
        "from_rate": F.col("base_geomean") * (F.col("other_rate") - F.col("base_rate")),
        "from_contigs": (F.col("other_geomean") - F.col("base_geomean")) * F.col("base_rate"),
    })
    d = d.withColumn("residual", F.col("total") - F.col("from_rate") - F.col("from_contigs"))
    return d.withColumn("unexplained", (F.abs("total") > 1e-12) & (F.abs("residual") > UNEXPLAINED * F.abs("total")))


def _paired(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    b = base.select("contig_name", *[F.col(k).try_cast("double").alias(f"b_{k}") if dict(base.dtypes)[k] == "string" else F.col(k).cast("double").alias(f"b_{k}") for k in keys])
    o = other.select("contig_name", *[F.col(k).try_cast("double").alias(f"o_{k}") if dict(other.dtypes)[k] == "string" else F.col(k).cast("double").alias(f"o_{k}") for k in keys])
    return b.join(o, "contig_name")


def paired_summary(base: DataFrame, other: DataFrame, keys: Sequence[str] = CONTIG_METRICS) -> DataFrame:
    """(metric, n, changed, p_changed, mean, se, median_changed, max_abs, up, down, z): all metrics in one join and pass."""
    keys = [k for k in keys if k in base.columns and k in other.columns]
    d = _paired(base, other, keys)
    out = []
    for k in keys:
        x = F.col(f"o_{k}") - F.col(f"b_{k}")
        n, up, down = F.count(x), F.count_if(x > CHANGE), F.count_if(x < -CHANGE)
        moved = up + down
        out.append(F.struct(
            F.lit(k).alias("metric"),
            n.alias("n"),
            moved.alias("changed"),
            F.coalesce(F.try_divide(moved, n), F.lit(0.0)).alias("p_changed"),
            F.avg(x).alias("mean"),
            F.coalesce(F.stddev_samp(x) / F.sqrt(n), F.lit(0.0)).alias("se"),
            F.coalesce(F.percentile(F.when(F.abs(x) > CHANGE, x), 0.5), F.lit(0.0)).alias("median_changed"),
            F.coalesce(F.max(F.abs(x)), F.lit(0.0)).alias("max_abs"),
            up.alias("up"),
            down.alias("down"),
            F.coalesce(F.try_divide((up - down).cast("double"), F.sqrt(moved)), F.lit(0.0)).alias("z"),
        ))
    return d.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def rank_discordance(base: DataFrame, other: DataFrame, n_contigs: int, pairs: int = 2_000_000, key: str = "contig_idx", exact: int = 3_000) -> DataFrame:
    """discordance, ties over pairs of contigs: how often the runs order two contigs oppositely.

    Contigs are numbered 0 to n_contigs - 1 in `key`. Up to `exact` contigs all pairs are taken; of more, as many as
    `pairs` says, drawn by a hash of their number, so the result does not change between runs; at two million the
    standard error is under 0.05 percent points. Pairs that either run ties are left out of discordance. Both are null
    under two contigs or if all pairs tie.
    """
    spark = base.sparkSession
    s = base.select(F.col(key).alias("k"), F.col("score").cast("double").alias("b")).join(other.select(F.col(key).alias("k"), F.col("score").cast("double").alias("o")), "k")
    n = max(n_contigs, 1)
    if n <= exact:
        drawn = spark.range(n * n).select(F.floor(F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j")).filter("i < j")
    else:
        h = F.md5(F.col("id").cast("string"))
        part = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("long") % n
        drawn = spark.range(pairs).select(part(1).alias("i"), part(17).alias("j")).filter("i <> j")
    d = drawn.join(small(s.toDF("i", "bi", "oi"), n), "i").join(small(s.toDF("j", "bj", "oj"), n), "j")
    x, y = F.signum(F.col("bi") - F.col("bj")), F.signum(F.col("oi") - F.col("oj"))
    free = (x != 0) & (y != 0)
    t = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(free).alias("free"), F.count_if(free & (x != y)).alias("against"))
    return t.select(F.try_divide(F.col("against").cast("double"), F.col("free")).alias("discordance"), (1 - F.try_divide(F.col("free").cast("double"), F.col("n"))).alias("ties"))


def rank_agreement(base: DataFrame, other: DataFrame, base_cutoff: float, other_cutoff: float) -> DataFrame:
    """pearson, both_good, both_bad, lost, gained, agree: one row; each run calls good by its own cutoff."""
    d = _paired(base, other, ["score"])
    b, o = F.col("b_score") >= base_cutoff, F.col("o_score") >= other_cutoff
    t = d.agg(
        F.corr("b_score", "o_score").alias("pearson"),
        F.count_if(b & o).alias("both_good"),
        F.count_if(~b & ~o).alias("both_bad"),
        F.count_if(b & ~o).alias("lost"),
        F.count_if(~b & o).alias("gained"),
        F.count(F.lit(1)).alias("__n"),
    )
    return t.withColumn("agree", F.try_divide(F.col("both_good") + F.col("both_bad"), F.col("__n"))).drop("__n")


def summary(base: DataFrame, other: DataFrame, base_contigs: DataFrame, other_contigs: DataFrame, n_contigs: int, pairs: int = 2_000_000) -> DataFrame:
    """d_score, d_goodrate, d_geomean, pearson, rank_disc: one row."""
    parts = decomposition(base, other).select(F.col("total").alias("d_score"), F.col("from_rate").alias("d_goodrate"), F.col("from_contigs").alias("d_geomean"))
    r = _paired(base_contigs, other_contigs, ["score"]).agg(F.corr("b_score", "o_score").alias("pearson"))
    x = rank_discordance(base_contigs, other_contigs, n_contigs, pairs).select(F.col("discordance").alias("rank_disc"))
    return parts.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(x))  # one row each
