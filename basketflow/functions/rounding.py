"""Rounding to decimal digits, as ``F.round`` does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SURE = 1e11  # up to here a product with a power of ten is off by less than the distance below
NEAR_HALF = 0.499


def rounded(col: Column, digits: int) -> Column:
    """``F.round`` of a double, which goes through decimal text for each value, only where a half is near or the value is large.

    Elsewhere the nearest whole number of units is the same one, and its
    quotient is the nearest double to that decimal.
    """
    units = col * F.lit(10.0**digits)
    whole = F.rint(units)
    sure = (F.abs(units) < SURE) & (F.abs(units - whole) < NEAR_HALF)
    # a sum with 0.0 is never -0.0
    return F.when(sure, whole / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(col, digits))
