"""Composition and open reading frames of nucleotide sequences.

Composition folds case; reading frames do not: codons with a letter other than upper-case A, C, G or T neither start
nor stop anything, so a wholly lower-case sequence is one open frame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("a", "c", "g", "t", "n")
DINUCLEOTIDES = tuple(x + y for x in BASES for y in BASES)
#: Codon patterns as read from the left, and as read from the right in the reversed forward sequence: a stop, anything
#: else, anything but a stop or start. They part by first letters, which takes less time than looking ahead everywhere.
_FORWARD = ("T(?:A[AG]|GA)", "(?:[^T]..|T(?:[^AG].|A[^AG]|G[^A]))", "(?:[^AT]..|T(?:[^AG].|A[^AG]|G[^A])|A(?:[^T].|T[^G]))")
_REVERSE = ("A(?:T[CT]|CT)", "(?:[^A]..|A(?:[^CT].|T[^CT]|C[^T]))", "(?:[^AT]..|A(?:[^CT].|T[^CT]|C[^T])|T(?:[^A].|A[^C]))")


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are one of letters."""
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def composition(seq: Column) -> dict[str, Column]:
    """Counts of a, c, g, t in either case and of everything else, n."""
    own = {b: count_of(seq, b + b.upper()) for b in "acgt"}
    return own | {"n": F.length(seq).cast("long") - (own["a"] + own["c"] + own["g"] + own["t"])}


def dinucleotides(seq: Column) -> dict[str, Column]:
    """Counts of the 25 ordered pairs of overlapping neighbours, by name."""
    folded = F.regexp_replace(F.translate(seq, "ACGT", "acgt"), "[^acgt]", "n")
    return {d: F.regexp_count(folded, F.lit(f"{d[0]}(?={d[1]})")).cast("long") for d in DINUCLEOTIDES}


def prop_gc(seq: Column) -> Column:
    """Share of g and c among all characters; 0 for an empty sequence."""
    return F.coalesce(F.try_divide(count_of(seq, "gcGC"), F.length(seq)), F.lit(0.0))


def _strand(seq: Column, stop: str, other: str, idle: str) -> Column:
    """Characters in the longest open stretch of the frames that begin at the first three characters.

    Before the first stop a frame is open from its beginning; after a stop it opens at the next start codon. Each frame is
    one pass; the codon loops are possessive and of fixed width, so they run without recursion and in linear time.
    """

    def frame(s: Column, k: int) -> Column:
        stretches = F.regexp_extract_all(s, F.lit(rf"(?s)(?:^.{{{k}}}(?!{stop})|(?:^.{{{k}}}|\G){stop}{idle}*+)({other}*+)"), F.lit(1))
        return F.array_max(F.transform(stretches, lambda t: F.length(t)))

    # a lambda's body is evaluated as it stands: bound to a variable, the sequence is made once and not once a frame
    return F.transform(F.array(seq), lambda s: F.greatest(F.lit(0), *[frame(s, k) for k in range(3)]))[0]


def longest_orf(seq: Column) -> Column:
    """Codons of the longest open reading frame of all six; 0 under three bases.

    A frame is open from the beginning of the sequence to its first stop, then from each start to the next stop or the
    end; the stop does not count.
    """
    return F.floor(F.greatest(_strand(seq, *_FORWARD), _strand(F.reverse(seq), *_REVERSE)) / 3).cast("long")
