"""Command line: assess assemblies, compare runs, compare picks; jobs, results and headers of many assemblies."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from txgauge import tools
from txgauge.plans import assess, fleet, reports
from txgauge.session import session
from txgauge.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="txgauge", description=__doc__)
    p.add_argument("--loglevel", default="info", choices=("debug", "info", "warning", "error"))
    p.add_argument("--master", help="Spark master; by default the cluster's own setting")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("assess", help="score assemblies")
    a.add_argument("-a", "--assembly", nargs="+", required=True)
    a.add_argument("-o", "--output", default="results")
    a.add_argument("--bam", nargs="+", help="alignments in read order, one file an assembly")
    a.add_argument("--quant", nargs="+", help="expression estimates, one table an assembly")
    a.add_argument("--left", help="left reads, a comma-separated list")
    a.add_argument("--right", help="right reads; with these and without --bam, aligner and quantifier are run")
    a.add_argument("-t", "--threads", type=int, default=8, help="of aligner and quantifier")
    a.add_argument("--keep-bam", action="store_true", help="keep the alignments made here")
    a.add_argument("--no-error-model", action="store_true")
    for f in fields(tools.Mapping):
        a.add_argument(f"--{f.name.replace('_', '-')}", type=int, default=f.default)
    a.add_argument("--fragments", type=int, help="read pairs in all; by default counted in --left")
    a.add_argument("--reference", help=argparse.SUPPRESS)
    c = sub.add_parser("compare", help="compare result folders")
    c.add_argument("runs", nargs="+", metavar="LABEL=FOLDER")
    c.add_argument("--baseline")
    c.add_argument("--replicate")
    g = sub.add_parser("picks", help="compare representatives of groups")
    g.add_argument("old_csv")
    g.add_argument("new_csv")
    of = g.add_mutually_exclusive_group(required=True)
    of.add_argument("--groups")
    of.add_argument("--orthogroups")
    g.add_argument("--out-prefix")
    m = sub.add_parser("manifest", help="list the jobs of a tree of pairs")
    m.add_argument("folder")
    m.add_argument("--out", help="by default manifest.tsv in the folder")
    m.add_argument("--allow-multi-run", action="store_true")
    m.add_argument("--skip-done", action="store_true")
    r = sub.add_parser("collect", help="merge the metrics of all results of a tree")
    r.add_argument("folder")
    r.add_argument("--out")
    r.add_argument("--pairs-csv")
    r.add_argument("--contigs", action="store_true", help="also merge the tables of contigs")
    n = sub.add_parser("normalise", help="shorten the headers of an archive's assembly")
    n.add_argument("fasta")
    n.add_argument("out")
    return p


def assessed(spark: SparkSession, args: argparse.Namespace) -> int:
    assess.run(spark, args.assembly, args.output, args.bam, args.quant, args.left, args.fragments)
    return 0


def from_reads(spark: SparkSession, args: argparse.Namespace) -> int:
    """Alignments and estimates first. Alignments are deleted only after all results are written."""
    out = Path(args.output).absolute()
    if (out / "assemblies.csv").exists():
        raise FileExistsError(f"{out}/assemblies.csv is there already")
    how = tools.Mapping(**{f.name: getattr(args, f.name) for f in fields(tools.Mapping)})
    try:
        made = tools.prepare([str(Path(a).absolute()) for a in args.assembly], args.left, args.right, out / "work", args.threads, how, not args.no_error_model)
        assess.run(spark, args.assembly, args.output, made.alignments, made.estimates, args.left, made.fragments)
    except BaseException:
        for path, size in tools.survivors(out):
            logging.error("kept for the next run: %s (%.1f MB)", path, size / 1e6)
        raise
    for path in [] if args.keep_bam else made.alignments:
        Path(path).unlink(missing_ok=True)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    logging.basicConfig(level=args.loglevel.upper(), format="%(asctime)s %(levelname)s %(message)s")
    if args.what == "assess" and args.reference:
        p.error("comparison with reference proteins is not supported")
    if args.what == "assess" and args.right and not args.left:
        p.error("--right needs --left")
    if args.what == "manifest":
        n, skipped = fleet.make_manifest(args.folder, args.out or f"{args.folder}/manifest.tsv", args.allow_multi_run, args.skip_done)
        for name, why in skipped:
            print(f"left out {name}: {why}")
        print(f"{n} jobs")
        return 0
    spark = session(args.master)
    if args.what == "collect":
        for name in fleet.collect(spark, args.folder, args.out, args.pairs_csv, args.contigs):
            print(f"no result yet: {name}")
        return 0
    if args.what == "normalise":
        print(f"{fleet.normalise(spark, args.fasta, args.out)} contigs")
        return 0
    if args.what == "assess":
        return from_reads(spark, args) if args.right and not args.bam else assessed(spark, args)
    if args.what == "picks":
        groups = tables.read_orthogroups(spark, args.orthogroups) if args.orthogroups else tables.read_group_files(spark, args.groups)
        d, counts = reports.compare_picks(spark, args.old_csv, args.new_csv, groups, args.out_prefix)
        counts.show(vertical=True)
        return 0
    runs = dict(r.partition("=")[::2] for r in args.runs)
    base = args.baseline or next(iter(runs))
    if len(runs) < 2 or base not in runs or args.replicate and args.replicate not in runs:
        p.error("at least two runs are needed, and baseline and replicate must be among them")
    valid = True
    for label, folder in runs.items():
        if label != base:
            r = reports.compare_runs(spark, runs[base], folder, runs.get(args.replicate))
            valid &= r.valid
            print(f"{base} -> {label}: {'valid' if r.valid else 'NOT THE SAME ASSEMBLY'}")
            for t in (r.assembly_validity, r.contig_validity, r.deltas, r.decomposition, r.paired, r.agreement, r.discordance):
                if t is not None:
                    t.show(100, truncate=False)
            print(r.summary)
    return int(not valid)


if __name__ == "__main__":
    sys.exit(main())
