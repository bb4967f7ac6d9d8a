"""Results of many assessments as one table, and which are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAD = ("pair_id", "organism", "lineage", "platform", "assembly_accession", "n_read_pairs", "result_dir")
_META = ("organism", "lineage", "platform", "assembly_accession")


def stacked(tables: list[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order they are first seen; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merged_metrics(results: DataFrame, pairs: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """LEAD, then the metrics of results (pair_id, result_dir, ...), as text, empty where nothing is known.

    pairs: pair_id and descriptions. manifest: pair_id, n_read_pairs.
    """
    metrics = [c for c in results.columns if c not in LEAD]
    d = results.select("pair_id", "result_dir", *metrics)
    if pairs is not None:
        have = [c for c in _META if c in pairs.columns]
        d = d.join(pairs.select("pair_id", *have).dropDuplicates(["pair_id"]), "pair_id", "left")
    if manifest is not None:
        d = d.join(manifest.select("pair_id", "n_read_pairs").dropDuplicates(["pair_id"]), "pair_id", "left")
    out = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in d.columns else F.lit("").alias(c) for c in (*LEAD, *metrics)]
    return d.select(*out)


def missing_jobs(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """pair_id of the manifest without a result, in order."""
    return manifest.select("pair_id").distinct().join(results.select("pair_id"), "pair_id", "left_anti").orderBy("pair_id")
