"""An assessment from files: sequences, then alignments and expression, then scores and the written tables."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.functions import alignment as A
from txgauge.functions import score as S
from txgauge.operators import accumulation, assembly_stats, assignment, coverage, fragment_size, rollup, scoring, segmentation
from txgauge.sources import bam, fasta, sinks, tables
from txgauge.session import shared_folder
from txgauge.sources.files import without_gzip_suffix

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Settings:
    """What may be changed in the model."""

    error_rate: float = A.ERROR_RATE
    orphan_fraction: float = A.ORPHAN_FRACTION
    clear_secondary: bool = True
    null_prior: float = segmentation.NULL_PRIOR
    pad_bins: bool = True
    faithful: bool = True
    distance: int | None = None


@dataclass
class Assessment:
    """Tables of one assembly; views of them are named by `register`."""

    contigs: DataFrame
    summary: dict[str, object]
    curve: DataFrame | None = None
    per_ref: DataFrame | None = None
    held: list[DataFrame] = field(default_factory=list)

    def register(self, prefix: str = "") -> None:
        self.contigs.createOrReplaceTempView(f"{prefix}contigs")
        if self.curve is not None:
            self.curve.createOrReplaceTempView(f"{prefix}score_curve")

    def release(self) -> None:
        for d in self.held:
            d.unpersist()


def reference_metrics(assigned: DataFrame, refs: DataFrame, distance: int, settings: Settings = Settings()) -> DataFrame:
    """refs (ref_id, name, length) with the counters, bases_uncovered, p_not_segmented and p_seq_true."""
    acc = accumulation.over_references(refs, accumulation.counters(assigned, distance))
    runs = coverage.runs(coverage.blocks(assigned, refs, refs.count()))
    seg = segmentation.prob_not_segmented(coverage.bin_states(refs, runs, pad=settings.pad_bins), null_prior=settings.null_prior)
    d = acc.join(coverage.bases_uncovered(refs, runs), "ref_id").join(seg, "ref_id", "left").withColumn("p_not_segmented", F.coalesce("p_not_segmented", F.lit(1.0)))
    return d.withColumn("p_seq_true", S.p_seq_true(F.col("scored_alignments"), F.col("edit_distance_total"), F.col("reads_mapped")))


def placed_metrics(alignments: DataFrame, refs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """reference_metrics of alignments that already have one placement a fragment."""
    distance = settings.distance if settings.distance is not None else fragment_size.realistic_distance(alignments, faithful=settings.faithful)
    return reference_metrics(alignments, refs, distance, settings)


def assess_sequences(contigs: DataFrame) -> Assessment:
    """Of contigs (contig_idx, name, seq, length) alone."""
    c = assembly_stats.sequence_columns(contigs).drop("seq").persist(StorageLevel.MEMORY_AND_DISK)
    stats: dict[str, object] = {}
    for t in (assembly_stats.basic_stats(c), assembly_stats.nx(c), assembly_stats.base_stats(contigs)):
        stats |= t.first().asDict()  # one row each
    return Assessment(c.withColumn("contig_name", F.col("name")), stats, held=[c])


def assess_reads(
    sequences: Assessment, alignments: DataFrame, refs: DataFrame, expression: DataFrame | None, fragments: int, read_length: int = 100, settings: Settings = Settings()
) -> Assessment:
    """sequences with all that the alignments say. Assigned records are held on disk, as two operators read them."""
    distance = settings.distance if settings.distance is not None else fragment_size.realistic_distance(alignments, faithful=settings.faithful)
    priors = assignment.prior_table(refs, expression)
    n_refs = refs.count()
    assigned = assignment.assign(alignments, priors, n_refs, settings.error_rate, settings.orphan_fraction, settings.clear_secondary)
    assigned = assigned.select("ref_id", "flag", "pos", "cigar", "query_len", "next_ref_id", "next_pos", "nm").persist(StorageLevel.DISK_ONLY)
    per_ref = reference_metrics(assigned, refs, distance, settings).persist(StorageLevel.MEMORY_AND_DISK)
    metrics = rollup.contig_metrics(sequences.contigs.drop("contig_name"), per_ref, expression, read_length or 100).persist(StorageLevel.MEMORY_AND_DISK)
    summary = sequences.summary | rollup.read_stats(metrics, fragments).first().asDict() | accumulation.clip_summary(per_ref).first().asDict()
    curve = scoring.score_curve(metrics, fragments)
    summary |= scoring.assembly_scores(metrics, summary["good_mappings"], fragments).first().asDict()
    summary |= scoring.optimum(curve).first().asDict()
    table = rollup.contig_table(metrics).withColumn("classification", S.classify(F.col("score"), F.lit(summary["cutoff"])))
    summary["good_contigs"] = table.filter("classification = 'good'").count()
    return Assessment(table, summary, curve, per_ref, [*sequences.held, assigned, per_ref, metrics])


def run(
    spark: SparkSession,
    assemblies: list[str],
    output: str,
    bam_paths: list[str] | None = None,
    quant_paths: list[str] | None = None,
    left: str | None = None,
    fragments: int | None = None,
    settings: Settings = Settings(),
    work: str | None = None,
) -> list[dict[str, object]]:
    """Assess assemblies and write contigs.csv and the curve of each, and assemblies.csv last, into output.

    fragments, the number of read pairs, is counted in left if it is not given. With several assemblies, each has its
    folder within output. A folder with an assemblies.csv is not written over. Decoded alignments go to work, a folder
    that all machines share; by default spark.checkpoint.dir, or output itself where the session is local.
    """
    out = Path(output).absolute()
    if (out / "assemblies.csv").exists():
        raise FileExistsError(f"{out}/assemblies.csv is there already")
    paths = [str(Path(p).absolute()) for p in assemblies]
    if len(set(paths)) < len(paths):
        raise ValueError("an assembly is given twice")
    names = [without_gzip_suffix(p).stem for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("two assemblies would share a result folder")
    reads = bam_paths is not None
    if reads and (len(bam_paths) != len(paths) or quant_paths is not None and len(quant_paths) != len(paths)):
        raise ValueError("there must be one set of alignments, and of estimates if any, for each assembly")
    if reads and fragments is None:
        if left is None:
            raise ValueError("the number of fragments is not known: give it, or the left reads")
        fragments, cut = tables.count_reads(left)
        for c in cut:
            log.warning("%s ends early; its reads count as far as they go", c)
    read_length = tables.longest_read(left) if left else 100
    rows = []
    for i, path in enumerate(paths):
        to = out / names[i] if len(paths) > 1 else out
        to.mkdir(parents=True, exist_ok=True)
        contigs = fasta.load_assembly(spark, path).persist(StorageLevel.MEMORY_AND_DISK)
        result = assess_sequences(contigs)
        if reads:
            if not bam.is_complete(bam_paths[i]):
                raise bam.MalformedBam(f"{bam_paths[i]} ends early")
            place = work or (f"file://{to}" if spark.sparkContext.master.startswith("local[") else shared_folder(spark))
            alignments, refs = bam.to_parquet(spark, bam_paths[i], f"{place}/{names[i]}.alignments.parquet")
            expression = None
            if quant_paths is not None:
                if problem := tables.quant_problem(quant_paths[i], refs.count()):
                    raise ValueError(f"{quant_paths[i]}: {problem}")
                expression = tables.read_quant(spark, quant_paths[i])
            result = assess_reads(result, alignments, refs, expression, fragments, read_length, settings)
            sinks.write_curve(result.curve, to / f"{without_gzip_suffix(path).name}_score_optimisation.csv")
        sinks.write_contigs(result.contigs, to / "contigs.csv", reads)
        for line in sinks.metric_lines(names[i], result.summary, sinks.assembly_columns(reads)):
            log.info(line)
        rows.append({"assembly": path} | result.summary)
        result.release()
        contigs.unpersist()
    columns = sinks.assembly_columns(reads)
    types = {c: "string" if c == "assembly" else "double" if any(isinstance(r.get(c), float) for r in rows) else "long" for c in columns if any(c in r for r in rows)}
    table = spark.createDataFrame([tuple(r.get(c) for c in types) for r in rows], ", ".join(f"{c} {t}" for c, t in types.items()))
    sinks.write_assemblies(table.coalesce(1), out / "assemblies.csv", reads)
    return rows
