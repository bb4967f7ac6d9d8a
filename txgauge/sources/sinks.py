"""Written results. Numbers are formatted by Python, as readers of these files expect: short exponents, rounded floats.

Rows come to the driver one partition at a time, in order; no file has more than a row a contig.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame

from txgauge.operators.assembly_stats import BASIC, COMPOSITION, NX
from txgauge.operators.rollup import CONTIG_COLUMNS, READ_STATS

TRAILING = ("score", "optimal_score", "cutoff", "weighted")
BASIC_CONTIG = CONTIG_COLUMNS[:4]
# fixed values: columns of comparisons with reference proteins, which no run has
REFERENCE_CONTIG = ("has_crb", "reference_coverage", "hits")


def contig_columns(reads: bool = True, reference: bool = False) -> tuple[str, ...]:
    return (*BASIC_CONTIG, *(REFERENCE_CONTIG if reference else ()), *(CONTIG_COLUMNS[4:] if reads else ()))


def assembly_columns(reads: bool = True) -> tuple[str, ...]:
    """Without reads the four scores stay, and are empty."""
    return ("assembly", *BASIC, *(f"n{p}" for p in NX), *COMPOSITION, *(READ_STATS if reads else ()), *TRAILING)


def plain(value: object, places: int | None) -> object:
    if value is None:
        return ""
    return round(value, places) if isinstance(value, float) and places is not None else value


def write_rows(df: DataFrame, path: str | Path, columns: Sequence[str], places: int | None = None, twice: dict[str, int] | None = None) -> None:
    """A CSV file of df's rows in their order; columns that df lacks are empty. twice: columns rounded to fewer places first."""
    have, twice = set(df.columns), twice or {}
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(columns)
        for r in df.select(*[c for c in columns if c in have]).toLocalIterator(prefetchPartitions=True):
            w.writerow([plain(plain(r[c], twice.get(c)) if c in twice else r[c], places) if c in have else "" for c in columns])


def write_contigs(table: DataFrame, path: str | Path, reads: bool = True) -> None:
    write_rows(table.orderBy("contig_idx"), path, contig_columns(reads), 6, {"coverage": 2})


def write_assemblies(rows: DataFrame, path: str | Path, reads: bool = True) -> None:
    write_rows(rows, path, assembly_columns(reads), 5)


def write_curve(curve: DataFrame, path: str | Path) -> None:
    write_rows(curve.orderBy("cutoff"), path, ("cutoff", "assembly_score"), 5)


ACCUMULATED = ("name", "p_seq_true", "bridges", "length", "fragments_mapped", "both_mapped", "properpair", "good", "bases_uncovered", "p_not_segmented")


def write_accumulated(per_ref: DataFrame, path: str | Path) -> None:
    """One row a reference, not rounded."""
    write_rows(per_ref.orderBy("ref_id"), path, ACCUMULATED)


def write_fasta(contigs: DataFrame, path: str | Path) -> None:
    with open(path, "w") as f:
        for r in contigs.orderBy("contig_idx").select("name", "seq").toLocalIterator(prefetchPartitions=True):
            f.write(f">{r['name']}\n{r['seq']}\n")


def write_picks(compared: DataFrame, prefix: str) -> None:
    """<prefix>.old.list, .new.list and .changed.tsv, in the order of the labels."""
    rows = compared.orderBy("label")
    with open(f"{prefix}.old.list", "w") as a, open(f"{prefix}.new.list", "w") as b, open(f"{prefix}.changed.tsv", "w") as c:
        c.write("group\tmembers\tbaseline_pick\tnew_pick\tbaseline_margin\tnew_margin\n")
        for r in rows.toLocalIterator(prefetchPartitions=True):
            a.write(f"{r['old_pick']}\n" if r["old_pick"] else "")
            b.write(f"{r['new_pick']}\n" if r["new_pick"] else "")
            if r["outcome"] == "changed":
                c.write(f"{r['label']}\t{r['size']}\t{r['old_pick']}\t{r['new_pick']}\t{r['old_margin']:.6f}\t{r['new_margin']:.6f}\n")


def write_manifest(jobs: list[tuple[str, str, str, str]], path: str | Path) -> None:
    with open(path, "w", newline="") as f:
        csv.writer(f, delimiter="\t", lineterminator="\n").writerows(jobs)


def metric_lines(title: str, values: dict[str, object], keys: Sequence[str]) -> list[str]:
    """Aligned lines of a log: whole numbers grouped, others with five places."""
    width = max((len(k) for k in keys if k in values), default=0)
    said = {k: f"{v:,.5f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v) for k, v in values.items()}
    return [title, *(f"{k:<{width}}  {said[k]:>16}" for k in keys if k in values)]
