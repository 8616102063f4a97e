"""Seeded pseudo-random integers from columns: plain arithmetic, so repeatable and inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixing rule: a Mersenne prime and two multipliers.
PRIME = 2147483647
STEP = 48271
TWIST = 16807


def mix(seed: int, *cols: Column) -> Column:
    """A value in [0, PRIME) that depends on the seed and on every column."""
    value = F.lit(int(seed) % PRIME).cast("long")
    for col in cols:
        value = (value + F.pmod(col.cast("long"), F.lit(PRIME))) % PRIME
        value = (value * STEP + 11) % PRIME
        value = ((value * value) % PRIME * TWIST + value) % PRIME
    return value


def mix_unit(seed: int, *cols: Column) -> Column:
    """``mix`` scaled to [0, 1)."""
    return mix(seed, *cols) / F.lit(float(PRIME))
