"""Comparison of written values, and proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEQUENCE_TOLERANCE = 1e-5


def verdict(left: Column, right: Column, tolerance: float = SEQUENCE_TOLERANCE) -> Column:
    """same, rounding (numbers no further apart than tolerance) or differs; null counts as empty text."""
    a, b = left.try_cast("double"), right.try_cast("double")
    apart = F.abs(a - b)
    return (
        F.when(F.coalesce(left, F.lit("")) == F.coalesce(right, F.lit("")), "same")
        .when(a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b) | (apart > tolerance), "differs")
        .when(apart > 0, "rounding")
        .otherwise("same")
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole, with 1 for a whole of 0."""
    return part / F.when(whole == 0, 1.0).otherwise(whole.cast("double"))
