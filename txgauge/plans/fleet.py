"""Many assessments: jobs of a tree of pairs, results as one table, headers of downloaded assemblies."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

from txgauge.operators import fleet
from txgauge.sources import fasta, sinks, tables


def make_manifest(folder: str, to: str, several_runs: bool = False, skip_done: bool = False) -> tuple[int, list[tuple[str, str]]]:
    """Write the jobs of a tree; how many there are, and what was left out and why."""
    jobs, skipped = tables.discover_pairs(folder, several_runs, skip_done)
    sinks.write_manifest(jobs, to)
    return len(jobs), skipped


def collect(spark: SparkSession, folder: str, to: str | None = None, pairs_csv: str | None = None, contigs: bool = False) -> list[str]:
    """Write the metrics of all results under folder as one CSV file, with contigs those of all contigs; jobs without a result."""
    base = Path(folder).absolute()
    results = tables.read_result_tree(spark, str(base / "results"))
    pairs, manifest = Path(pairs_csv or base / "pairs_seed.csv"), base / "manifest.tsv"
    known = tables.read_pairs(spark, str(pairs)) if pairs.exists() else None
    jobs = tables.read_manifest(spark, str(manifest)) if manifest.exists() else None
    merged = fleet.merged_metrics(results, known, jobs).orderBy("pair_id")
    sinks.write_rows(merged, to or base / "assembly_metrics.csv", merged.columns)
    if contigs:
        every = tables.read_contig_tree(spark, str(base / "results")).orderBy("pair_id")
        sinks.write_rows(every, base / "contig_metrics.csv", every.columns)
    return [r["pair_id"] for r in fleet.missing_jobs(jobs, results).toLocalIterator()] if jobs is not None else []


def normalise(spark: SparkSession, path: str, to: str) -> int:
    """Write an assembly with the names that archive_name gives; how many contigs it has. Raises if names would be alike."""
    d = fasta.with_archive_names(fasta.read_fasta(spark, path))
    sinks.write_fasta(d, to)
    return d.count()
