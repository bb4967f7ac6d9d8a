"""Comparisons of written runs, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.operators import comparison, picks
from txgauge.session import numbered
from txgauge.sources import sinks, tables


@dataclass
class Report:
    valid: bool
    assembly_validity: DataFrame
    contig_validity: DataFrame
    deltas: DataFrame
    decomposition: DataFrame
    paired: DataFrame | None = None
    agreement: DataFrame | None = None
    discordance: DataFrame | None = None
    summary: str = ""


def compare_runs(spark: SparkSession, base: str, other: str, replicate: str | None = None, pairs: int = 2_000_000) -> Report:
    """What differs between the result folders base and other; paired parts only where both have the same contigs."""
    (a, c), (b, d) = tables.load_run(spark, base), tables.load_run(spark, other)
    r = tables.load_run(spark, replicate)[0] if replicate else None
    va, vc = comparison.assembly_validity(a, b), comparison.contig_validity(c, d)
    out = Report(comparison.is_valid(va, vc).first()["valid"], va, vc, comparison.metric_deltas(a, b, r), comparison.decomposition(a, b))
    same = vc.filter("metric = 'contig_set' and differing = 0").count() == 1
    if same and "score" in c.columns and "score" in d.columns:
        out.paired = comparison.paired_summary(c, d)
        cut = [float(x.first()["cutoff"]) for x in (a, b)]
        number = lambda x: x.withColumn("score", F.col("score").try_cast("double"))
        out.agreement = comparison.rank_agreement(number(c), number(d), *cut)
        # contigs are numbered in the order of the first run's file
        ids = numbered(tables.scan_csv(spark, f"{base}/contigs.csv"), "contig_idx").select("contig_name", "contig_idx")
        out.discordance = comparison.rank_discordance(number(c).join(ids, "contig_name"), number(d).join(ids, "contig_name"), ids.count(), pairs)
    out.summary = summary_line(str(a.first()["assembly"]) if "assembly" in a.columns else "?", out)
    return out


def summary_line(assembly: str, r: Report) -> str:
    """One line for each comparison: what changed in the score and why, and how alike the runs rank contigs."""
    d = r.decomposition.first()
    said = [f"d_score={d['total']:+.5f}"] if d["total"] is not None else []
    if d["from_rate"] is not None:
        said += [f"d_goodrate={d['from_rate']:+.5f}", f"d_geomean={d['from_contigs']:+.5f}"]
    if r.agreement is not None:
        pearson, discordance = r.agreement.first()["pearson"], r.discordance.first()["discordance"]
        said += [f"pearson={pearson:.5f}" if pearson is not None else "pearson=nan", f"rank_disc={discordance:.4f}" if discordance is not None else "rank_disc=nan"]
    return "  ".join(["SUMMARY", assembly, *said])


def compare_picks(spark: SparkSession, old_csv: str, new_csv: str, groups: DataFrame, prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(groups compared, counts of outcomes); with prefix, the lists are written too."""
    old, new = (picks.best_scores(tables.read_scores(spark, p)) for p in (old_csv, new_csv))
    d = picks.compared(groups, old, new)
    if prefix:
        sinks.write_picks(d, prefix)
    return d, picks.outcome_counts(d)
