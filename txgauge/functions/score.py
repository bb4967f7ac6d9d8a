"""Contig scores from their four components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least value of every component, and of the product again.
FLOOR = 0.01
#: p_not_segmented, p_good and p_seq_true of contigs that no alignment header names.
DEFAULTS = {"p_seq_true": 0.0, "p_good": 0.0, "p_not_segmented": 1.0}


def _floored(x: Column) -> Column:
    return F.greatest(x, F.lit(FLOOR))


def p_bases_covered(uncovered: Column, length: Column) -> Column:
    """1 less the share of uncovered bases, which is 1 for an empty contig."""
    return 1 - F.coalesce(F.try_divide(uncovered, length), F.lit(1.0))


def contig_score(covered: Column, not_segmented: Column, good: Column, seq_true: Column) -> Column:
    return _floored(_floored(covered) * _floored(not_segmented) * _floored(good) * _floored(seq_true))


def alternative_scores(covered: Column, not_segmented: Column, good: Column, seq_true: Column) -> dict[str, Column]:
    """Products that leave one component out, not floored as a whole."""
    parts = {"cov": _floored(covered), "seg": _floored(not_segmented), "good": _floored(good), "seq": _floored(seq_true)}
    out = {}
    for left_out in parts:
        a, b, c = (v for k, v in parts.items() if k != left_out)
        out[left_out] = a * b * c
    return out


def classify(score: Column, cutoff: Column) -> Column:
    """A score on the cutoff is good."""
    return F.when(score >= cutoff, "good").otherwise("bad")


def p_good(good: Column, fragments: Column) -> Column:
    """0 unless more than one fragment is mapped."""
    return F.when(fragments > 1, good / fragments).otherwise(0.0)


def p_seq_true(scored: Column, edits: Column, reads: Column, scale: int = 35) -> Column:
    """Mean of (scale - edits) / scale over the alignments, from integers; 1 without reads, not clamped."""
    return F.when(reads > 0, (scale * scored - edits) / (scale * reads)).otherwise(1.0)


def mean_coverage(eff_count: Column, eff_length: Column, read_length: Column | int) -> Column:
    return F.coalesce(F.try_divide(eff_count * read_length, eff_length.cast("double")), F.lit(0.0))
