"""Bins of a contig and the states of their mean depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS, MOST_STATE, STATES = 30, 24, 24


def bin_width(length: Column, bins: int = BINS) -> Column:
    return F.floor(length / bins) + 1


def bin_size(length: Column, width: Column, number: Column) -> Column:
    """Bases in a bin; the last one is shorter, and padding has none."""
    return F.greatest(F.least(width, length - number * width), F.lit(0))


def state_of(total: Column, size: Column, most: int = MOST_STATE) -> Column:
    """Floor of the binary logarithm of the integer mean, by its number of digits; 0 for depth under 1."""
    mean = F.coalesce(F.floor(F.try_divide(total, size)), F.lit(0)).cast("long")
    return F.when(mean > 0, F.least(F.lit(most), F.length(F.bin(mean)) - 1)).otherwise(0)
