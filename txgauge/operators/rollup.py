"""The contigs table of an assessment, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgauge.functions import score as S
from txgauge.functions.values import share

SEGMENTED, UNCOVERED, LOW_COVERED = 0.5, 1, 10
READ_STATS = (
    "fragments", "fragments_mapped", "p_fragments_mapped", "good_mappings", "p_good_mapping", "bad_mappings", "potential_bridges",
    "bases_uncovered", "p_bases_uncovered", "contigs_uncovbase", "p_contigs_uncovbase", "contigs_uncovered", "p_contigs_uncovered",
    "contigs_lowcovered", "p_contigs_lowcovered", "contigs_segmented", "p_contigs_segmented",
)
CONTIG_COLUMNS = (
    "contig_name", "length", "prop_gc", "orf_length", "in_bridges", "p_good", "p_bases_covered", "p_seq_true", "score",
    "p_not_segmented", "eff_length", "eff_count", "tpm", "coverage", "sCnuc", "sCcov", "sCord", "sCseg",
)


def contig_metrics(contigs: DataFrame, per_ref: DataFrame, expression: DataFrame | None, read_length: int = 100) -> DataFrame:
    """contigs (contig_idx, name, length, ...) with everything known of them, defaults where nothing is.

    per_ref: name, the counters, bases_uncovered and p_not_segmented of every reference of the alignment header;
    names join exactly, and those that are no contig are dropped. expression: name, eff_len, eff_count, tpm; of its
    names the first word counts. `headed` and `expressed` tell whether a contig was found in either.
    """
    r = per_ref.select("name", F.lit(True).alias("headed"), "bases_uncovered", "p_not_segmented", "fragments_mapped", "good", "bridges", "scored_alignments", "edit_distance_total", "reads_mapped")
    d = contigs.join(r, "name", "left")
    if expression is None:
        none = {"expressed": F.lit(None).cast("boolean"), "eff_length": F.lit(0).cast("long"), "eff_count": F.lit(0.0), "tpm": F.lit(0.0)}
        d = d.withColumns(none)
    else:
        name = F.regexp_extract("name", r"\S+", 0)
        e = expression.select(name.alias("name"), F.lit(True).alias("expressed"), F.col("eff_len").cast("long").alias("eff_length"), F.col("eff_count").cast("double"), F.col("tpm").cast("double"))
        d = d.join(e, "name", "left")
    on = F.coalesce("headed", F.lit(False))
    filled = {
        "headed": on,
        "expressed": F.coalesce("expressed", F.lit(False)),
        "bases_uncovered": F.coalesce("bases_uncovered", F.col("length")).cast("long"),
        "p_not_segmented": F.coalesce("p_not_segmented", F.lit(S.DEFAULTS["p_not_segmented"])),
        "p_seq_true": F.when(on, S.p_seq_true(F.col("scored_alignments"), F.col("edit_distance_total"), F.col("reads_mapped"))).otherwise(S.DEFAULTS["p_seq_true"]),
        "p_good": F.when(on, S.p_good(F.col("good"), F.col("fragments_mapped"))).otherwise(S.DEFAULTS["p_good"]),
        "in_bridges": F.coalesce("bridges", F.lit(0)).cast("long"),
        "fragments_mapped": F.coalesce("fragments_mapped", F.lit(0)).cast("long"),
        "good": F.coalesce("good", F.lit(0)).cast("long"),
        "eff_length": F.coalesce("eff_length", F.lit(0)).cast("long"),
        "eff_count": F.coalesce("eff_count", F.lit(0.0)),
        "tpm": F.coalesce("tpm", F.lit(0.0)),
    }
    d = d.withColumns(filled)
    d = d.withColumns({"p_bases_covered": S.p_bases_covered(F.col("bases_uncovered"), F.col("length")), "coverage": S.mean_coverage(F.col("eff_count"), F.col("eff_length"), read_length)})
    parts = [F.col(c) for c in ("p_bases_covered", "p_not_segmented", "p_good", "p_seq_true")]
    return d.withColumn("score", S.contig_score(*parts))


def read_stats(metrics: DataFrame, fragments: int, n_contigs: int | None = None) -> DataFrame:
    """READ_STATS, one row, from contig_metrics: contigs count only where the alignment header or expression has them."""
    on, low = F.col("headed"), F.col("expressed")
    t = metrics.agg(
        F.coalesce(F.sum("fragments_mapped"), F.lit(0)).alias("fragments_mapped"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good_mappings"),
        F.count_if(F.col("in_bridges") > 1).alias("potential_bridges"),
        F.coalesce(F.sum(F.when(on, F.col("bases_uncovered"))), F.lit(0)).alias("bases_uncovered"),
        F.count_if(on & (F.col("bases_uncovered") > 0)).alias("contigs_uncovbase"),
        F.count_if(low & (F.col("coverage") < UNCOVERED)).alias("contigs_uncovered"),
        F.count_if(low & (F.col("coverage") < LOW_COVERED)).alias("contigs_lowcovered"),
        F.count_if(on & (F.col("p_not_segmented") < SEGMENTED)).alias("contigs_segmented"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("__bases"),
        F.count(F.lit(1)).alias("__n"),
    )
    f, n, b = F.lit(fragments), F.col("__n") if n_contigs is None else F.lit(n_contigs), F.col("__bases")
    t = t.withColumns({
        "fragments": f.cast("long"),
        "bad_mappings": F.col("fragments_mapped") - F.col("good_mappings"),
        "p_fragments_mapped": share(F.col("fragments_mapped"), f),
        "p_good_mapping": share(F.col("good_mappings"), f),
        "p_bases_uncovered": share(F.col("bases_uncovered"), b),
        **{f"p_{c}": share(F.col(c), n) for c in ("contigs_uncovbase", "contigs_uncovered", "contigs_lowcovered", "contigs_segmented")},
    })
    return t.select(*READ_STATS)


def contig_table(metrics: DataFrame) -> DataFrame:
    """CONTIG_COLUMNS with contig_idx in front; the four components repeat under their short names."""
    d = metrics.withColumns({
        "contig_name": F.col("name"),
        "sCnuc": F.col("p_seq_true"),
        "sCcov": F.col("p_bases_covered"),
        "sCord": F.col("p_good"),
        "sCseg": F.col("p_not_segmented"),
    })
    return d.select("contig_idx", *CONTIG_COLUMNS)
