"""Items a customer did not pick, drawn without listing the catalog per query.

Per query the draw walks the residues of a prime p ≥ n_items from a seeded
start with a seeded stride.  The walk meets every residue once, so
``n + forbidden + (p - n_items)`` steps always contain ``n`` allowed items
when that many exist: no retry and no catalog join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions.mixing import mix
from basketflow.operators.ordering import row_index


def next_prime(n: int) -> int:
    candidate = max(int(n), 2)
    while any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


def _drawn(query_id: Column, forbidden: Column, n_items: int, n: int, seed: int) -> Column:
    """Up to ``n`` distinct items outside ``forbidden``, in draw order."""
    p = next_prime(n_items)
    start = mix(seed, query_id) % p
    stride = mix(seed + 1, query_id) % (p - 1) + 1
    steps = F.least(F.size(forbidden) + (n + p - n_items), F.lit(p))
    walk = F.transform(F.sequence(start, start + (steps - 1) * stride, stride), lambda x: x % p)
    return F.slice(F.array_except(F.filter(walk, lambda x: x < n_items), forbidden), 1, n)


def forbidden_items(history: Column, positive: Column) -> Column:
    return F.array_distinct(F.concat(history, F.array(positive)))


def with_negatives(sequences: DataFrame, n_items: int, n: int, seed: int = 42) -> DataFrame:
    """Adds ``neg``: min(n, available) items outside history and target; empty when none is left."""
    forbidden = forbidden_items(F.col("history"), F.col("pos_item_idx"))
    return sequences.withColumn("neg", _drawn(F.col("query_id"), forbidden, n_items, n, seed))


def with_epoch_negatives(sequences: DataFrame, n_items: int, n: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """Adds ``neg`` with exactly ``n`` items, drawn anew per epoch.

    When fewer than ``n`` items are available the list repeats from its start;
    with none available it is empty.
    """
    forbidden = forbidden_items(F.col("history"), F.col("pos_item_idx"))
    rows = sequences.withColumn("_neg", _drawn(F.col("query_id"), forbidden, n_items, n, seed + 7 * epoch))
    repeats = F.ceil(F.lit(n) / F.size("_neg")).cast("int")
    cycled = F.slice(F.flatten(F.array_repeat(F.col("_neg"), repeats)), 1, n)
    return rows.withColumn("neg", F.when(F.size("_neg") > 0, cycled).otherwise(F.col("_neg"))).drop("_neg")


def fixed_sample(df: DataFrame, n: int, key: str = "query_id", seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows (all rows when there are fewer), however many ``n`` is."""
    return row_index(df, [mix(seed, F.col(key)), F.col(key)], "_place").where(F.col("_place") < n).drop("_place")


def set_difference(left: Column, right: Column) -> Column:
    return F.array_except(left, right)


def set_union(left: Column, right: Column) -> Column:
    return F.array_union(left, right)
