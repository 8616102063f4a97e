"""A bitmap of fixed size that tells tasks which keys a later join can need; it passes some others, and loses none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """2 ** ``bits`` bits, with those set that the low bits of the long ``column`` name.

    The words are put together on the cluster; the driver gets 2 ** (bits - 6) of them at most.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, int({column} & 63))")
    words = keys.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def is_set(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each of ``keys`` (long) is set."""
    slots = keys.astype(np.int64).view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)
