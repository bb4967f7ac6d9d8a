"""Text tables around an assessment: expression estimates, reads, runs, groups, manifests and trees of results."""

from __future__ import annotations

import re
from itertools import islice
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgauge.operators.fleet import stacked
from txgauge.session import numbered
from txgauge.sources.files import open_bytes, open_text

QUANT = "name string, length int, eff_len long, tpm double, eff_count double"
READS = 5_000
# fixed values: how names of assembly files end; whatever is packed counts too
ASSEMBLY_SUFFIXES = (".fa", ".fasta", ".fsa_nt", ".gz")


# expression


def quant_problem(path: str, references: int | None = None) -> str | None:
    """What keeps a table of estimates from being complete: no rows, no end of line, a short last row, too few rows."""
    p = Path(path)
    if not p.is_file() or not p.stat().st_size:
        return "it is missing or empty"
    rows, last, ends = 0, b"", False
    with p.open("rb") as f:
        for line in f:
            ends = line.endswith(b"\n")
            if line.strip():
                rows, last = rows + 1, line
    if not ends:
        return "its last line has no end"
    if rows < 2:
        return "it has no rows"
    if len(last.rstrip(b"\n").split(b"\t")) != 5:
        return "its last row has not five fields"
    if references is not None and rows - 1 != references:
        return f"it has {rows - 1} rows for {references} references"
    return None


def parse_quant(lines: DataFrame) -> DataFrame:
    """(name, length, eff_len, tpm, eff_count) of lines (value) of a table of estimates; effective lengths are cut to whole numbers.

    Rows without just five fields raise when they are read.
    """
    t = lines.filter("trim(value) <> ''").withColumn("f", F.split("value", "\t"))
    head = F.col("f")[0] == "Name"
    bad = F.raise_error(F.concat(F.lit("not five fields: "), F.col("value")))
    f = F.when(F.size("f") == 5, F.col("f")).otherwise(bad.cast("array<string>"))
    return t.filter(~head).select(f.alias("f")).select(
        F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("length"), F.col("f")[2].cast("double").cast("long").alias("eff_len"), F.col("f")[3].cast("double").alias("tpm"), F.col("f")[4].cast("double").alias("eff_count")
    )


def read_quant(spark: SparkSession, path: str) -> DataFrame:
    """parse_quant of a file."""
    return parse_quant(spark.read.text(str(path)))


# reads


def longest_read(paths: str) -> int:
    """Of the first reads in the first file of a comma-separated list."""
    with open_text(paths.split(",")[0]) as f:
        return max((len(x.strip()) for i, x in enumerate(islice(f, 4 * READS)) if i % 4 == 1), default=0)


def count_reads(paths: str) -> tuple[int, list[str]]:
    """Reads in all files of a list, and the files that end early: those count as far as they can be read."""
    lines, cut = 0, []
    for path in paths.split(","):
        own = 0
        try:
            with open_bytes(path) as f:
                for _ in f:
                    own += 1
        except (EOFError, OSError):
            cut.append(path)
        lines += own
    return lines // 4, cut


# runs


def scan_csv(spark: SparkSession, *paths: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Text values; multiline fields and doubled quotes as the usual writers leave them."""
    return spark.read.csv(list(map(str, paths)), sep=sep, header=header, quote='"', escape='"')


def load_run(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(assemblies, contigs) of a result folder; one assembly only."""
    a, c = scan_csv(spark, f"{folder}/assemblies.csv"), scan_csv(spark, f"{folder}/contigs.csv")
    n = a.count()
    if n != 1:
        raise ValueError(f"{folder}/assemblies.csv has {n} rows, but one assembly is compared at a time")
    return a, c


def read_scores(spark: SparkSession, path: str, column: int = 8) -> DataFrame:
    """(name, score) by the place of columns; rows that are short or have no number there are left out."""
    d = numbered(scan_csv(spark, path, header=False), "__i", "__own").filter("__own > 0").drop("__i", "__own")
    if len(d.columns) <= column + 1:
        return spark.createDataFrame([], "name string, score double")
    return d.select(F.col(d.columns[0]).alias("name"), F.col(d.columns[column]).try_cast("double").alias("score")).filter("score is not null")


def parse_orthogroups(lines: DataFrame) -> DataFrame:
    """(label, members) of lines (value, at from 0): the first word is dropped; labels are <line>.groups and sort as text."""
    words = F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))
    d = lines.select(F.concat((F.col("at") + 1).cast("string"), F.lit(".groups")).alias("label"), words.alias("w")).filter(F.size("w") > 0)
    return d.select("label", F.slice("w", 2, F.size("w")).alias("members"))


def read_orthogroups(spark: SparkSession, path: str) -> DataFrame:
    """parse_orthogroups of a file."""
    return parse_orthogroups(numbered(spark.read.text(str(path)), "at"))


def read_group_files(spark: SparkSession, folder: str) -> DataFrame:
    """(label, members) of the *groups files in a folder, a member a line."""
    t = spark.read.text(f"{folder}/*groups", wholetext=True).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("label"))
    names = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return t.select("label", names.alias("members"))


# fleets


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(pair_id, n_read_pairs) of lines (value) of at least three fields: identifier, assembly, reads."""
    t = lines.filter("trim(value) <> ''").select(F.split("value", "\t").alias("f"))
    return t.select(F.col("f")[0].alias("pair_id"), F.when(F.size("f") >= 3, F.size(F.split(F.get("f", F.lit(2)), ",")).cast("long")).alias("n_read_pairs"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(str(path)))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Descriptions of the pairs: a CSV file with a column pair_id; of several rows of a pair the last one."""
    d = scan_csv(spark, path)
    rest = [c for c in d.columns if c != "pair_id"]
    last = numbered(d, "__at").groupBy("pair_id").agg(F.max_by(F.struct(*rest), "__at").alias("r"))
    return last.select("pair_id", "r.*") if rest else d.distinct()


def read_result_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, result_dir, ...) of every folder of results with an assemblies.csv that is not empty."""
    found = [p for p in sorted(Path(folder).glob("*/assemblies.csv")) if p.stat().st_size]
    if not found:
        raise FileNotFoundError(f"no assemblies.csv under {folder}")
    heads: dict[str, list[Path]] = {}
    for p in found:
        with p.open() as f:
            heads.setdefault(f.readline(), []).append(p)
    out = []
    for paths in heads.values():  # one read for each set of columns
        d = scan_csv(spark, *map(str, paths)).withColumn("__p", F.split(F.col("_metadata.file_path"), "/"))
        base = F.lit(f"{folder}/")
        d = d.withColumns({"pair_id": F.element_at("__p", -2), "result_dir": F.concat(base, F.element_at("__p", -2))}).drop("__p")
        out.append(d.select("pair_id", "result_dir", *[F.col(f"`{c}`").alias(c.strip()) for c in d.columns if c not in ("pair_id", "result_dir") and c.strip()]))
    return stacked(out)


def read_contig_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(pair_id, ...) of every contigs.csv in or below a folder of results."""
    found = sorted(Path(folder).glob("*/**/contigs.csv"))
    rel = F.substring(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), len(str(Path(folder).resolve())) + 2, 4096)
    d = scan_csv(spark, *map(str, found))
    return d.select(F.split(rel, "/")[0].alias("pair_id"), *d.columns)


def discover_pairs(folder: str, several_runs: bool = False, skip_done: bool = False) -> tuple[list[tuple[str, str, str, str]], list[tuple[str, str]]]:
    """(jobs, skipped) of a tree pairs/<id>/{assembly,reads}: the largest assembly file and the mates of each run."""
    jobs, skipped = [], []
    for d in sorted(p for p in (Path(folder) / "pairs").iterdir() if p.is_dir()):
        files = lambda name, d=d: [p for p in sorted((d / name).glob("*")) if p.is_file() and p.stat().st_size]
        assemblies = [p for p in files("assembly") if p.name.endswith(ASSEMBLY_SUFFIXES)]
        mates: dict[str, dict[str, str]] = {}
        single = False
        for p in files("reads"):
            if m := re.fullmatch(r"(.+?)_([12])\.fastq(?:\.gz)?", p.name):
                mates.setdefault(m[1], {})[m[2]] = str(p)
            elif re.fullmatch(r".+?\.fastq(?:\.gz)?", p.name):
                single = True
        whole = [m for _, m in sorted(mates.items()) if len(m) == 2]
        why = (
            "already done" if skip_done and (Path(folder) / "results" / d.name / "assemblies.csv").exists()
            else "no assembly file" if not assemblies
            else ("only unpaired reads" if single else "no read files") if not whole
            else f"{len(whole)} read pairs" if len(whole) > 1 and not several_runs
            else None
        )
        if why:
            skipped.append((d.name, why))
        else:
            jobs.append((d.name, str(max(assemblies, key=lambda p: p.stat().st_size)), ",".join(m["1"] for m in whole), ",".join(m["2"] for m in whole)))
    return jobs, skipped
