"""Flags, likelihoods and CIGARs of alignment records."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: SAM flag bits
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, SUPPLEMENTARY = 1, 2, 4, 8, 16, 32, 64, 128, 256, 2048
# fixed values: CIGAR operations by number
M, I, D, N, S, H, P, EQ, X = range(9)  # noqa: E741
LETTERS = "MIDNSHP=X"

ERROR_RATE, ORPHAN_FRACTION, PSEUDOCOUNT = 0.01, 0.15, 1e-3


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(bit) != 0


def mate_mapped(flag: Column) -> Column:
    return has(flag, PAIRED) & ~has(flag, MATE_UNMAPPED)


def counts_fragment(flag: Column) -> Column:
    """Read 1, or read 2 whose mate is not mapped."""
    return has(flag, READ1) | (has(flag, READ2) & ~mate_mapped(flag))


def counts_pair(flag: Column) -> Column:
    return has(flag, READ1) & mate_mapped(flag)


def is_bridge(flag: Column, ref: Column, next_ref: Column) -> Column:
    return counts_pair(flag) & (ref != next_ref)


def is_good(flag: Column, ref: Column, next_ref: Column, pos: Column, next_pos: Column, distance: Column | int) -> Column:
    """Pair on one reference, on opposite strands facing each other, no further apart than distance."""
    inner = (~has(flag, REVERSE) & has(flag, MATE_REVERSE) & (pos < next_pos)) | (has(flag, REVERSE) & ~has(flag, MATE_REVERSE) & (next_pos < pos))
    return counts_pair(flag) & (ref == next_ref) & (F.abs(pos - next_pos) <= distance) & inner


def log_likelihood(nm: Column, length: Column, error_rate: float = ERROR_RATE) -> Column:
    """nm errors in length bases, nm kept within 0 and length; without nm a perfect match, without length 0."""
    n = F.least(F.greatest(F.coalesce(nm, F.lit(0)), F.lit(0)), length).cast("double")
    return F.when(length > 0, n * math.log(error_rate) + (length - n) * math.log1p(-error_rate)).otherwise(0.0)


def orphan_cost(length: Column, error_rate: float = ERROR_RATE, fraction: float = ORPHAN_FRACTION) -> Column:
    """What a candidate pays for a mate that it does not explain."""
    n = length * fraction
    return F.when(length > 0, n * math.log(error_rate) + (length - n) * math.log1p(-error_rate)).otherwise(0.0)


def prior(eff_count: Column) -> Column:
    return F.coalesce(eff_count, F.lit(0.0)) + PSEUDOCOUNT


def parse_cigar(text: Column) -> Column:
    """Operations of a CIGAR as text, in order; none for *."""
    one = lambda x: F.struct((F.position(F.right(x, F.lit(1)), F.lit(LETTERS)) - 1).cast("int").alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"))
    return F.transform(F.regexp_extract_all(text, F.lit(f"[0-9]+[{LETTERS}]"), F.lit(0)), one)


def _consumed(cigar: Column, ops: tuple[int, ...]) -> Column:
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin(*ops)), F.lit(0).cast("long"), lambda z, c: z + c["len"])


def query_length(cigar: Column) -> Column:
    """Bases of the read that the operations use; a record whose sequence has another length is malformed."""
    return _consumed(cigar, (M, I, S, EQ, X))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference from the first to the last."""
    return _consumed(cigar, (M, D, N, EQ, X))


def covered_blocks(pos: Column, cigar: Column, ref_length: Column) -> Column:
    """Half-open reference blocks under M, = and X, clipped to the reference; deletions and skips only move on."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(z: Column, c: Column) -> Column:
        op, n = c["op"], c["len"]
        covers, moves = op.isin(M, EQ, X), op.isin(M, EQ, X, D, N)
        block = F.array(F.struct(z["at"].alias("start"), F.least(z["at"] + n, ref_length.cast("int")).alias("end")))
        return F.struct(F.when(moves, z["at"] + n).otherwise(z["at"]).alias("at"), F.when(covers & (z["at"] < ref_length), F.concat(z["blocks"], block)).otherwise(z["blocks"]).alias("blocks"))

    return F.aggregate(cigar, F.struct(pos.cast("int").alias("at"), none.alias("blocks")), step, lambda z: z["blocks"])


def clipped_bases(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda c: c["op"] == S), F.lit(0).cast("long"), lambda z, c: z + c["len"])


def leading_clipped_bases(cigar: Column) -> Column:
    """Only of a soft clip that is the first operation."""
    first = F.get(cigar, F.lit(0))
    return F.when(first["op"] == S, first["len"]).otherwise(0).cast("long")


def read_length(seq_length: Column, cigar: Column) -> Column:
    """Of the stored sequence, else by the CIGAR, clips included; else 0."""
    said = F.aggregate(F.filter(cigar, lambda c: c["op"].isin(M, I, S, H, EQ, X)), F.lit(0), lambda z, c: z + c["len"])
    return F.coalesce(F.when(seq_length > 0, seq_length), said, F.lit(0)).cast("int")
