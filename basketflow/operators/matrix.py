"""The user × item table as long rows, and products of it with itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.operators.sequences import until_last_train

# A user (or item) with more partners than this takes the block product.
WIDE = 512
BLOCK = 1024


def interaction_matrix(sequences: DataFrame, history_weight: float = 0.5, positive_weight: float = 1.0) -> DataFrame:
    """``(user_idx, item_idx, weight)``: targets and history items, duplicates summed."""
    targets = sequences.select("user_idx", F.col("pos_item_idx").alias("item_idx"), F.lit(positive_weight).alias("w"))
    earlier = sequences.select("user_idx", F.explode("history").alias("item_idx"), F.lit(history_weight).alias("w"))
    return targets.unionByName(earlier).groupBy("user_idx", "item_idx").agg(F.sum("w").alias("weight"))


def count_matrix(lines: DataFrame, sequences: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Lines per (user, item), up to the last training sample when sequences are given."""
    if sequences is not None:
        lines = until_last_train(lines, sequences, ts)
    return lines.groupBy("user_idx", "item_idx").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def without_cells(matrix: DataFrame, held_out: DataFrame) -> DataFrame:
    """The matrix without the held-out (user, item) cells."""
    return matrix.join(held_out.select("user_idx", "item_idx"), ["user_idx", "item_idx"], "left_anti")


def matrix_statistics(matrix: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """``(n_users, n_items, nonzeros, density)``."""
    cells = float(max(n_users * n_items, 1))
    return matrix.where(F.col("weight") != 0).agg(F.count(F.lit(1)).alias("nonzeros")).select(
        F.lit(n_users).cast("long").alias("n_users"), F.lit(n_items).cast("long").alias("n_items"),
        "nonzeros", (F.col("nonzeros") / cells).alias("density"),
    )


def user_profile(matrix: DataFrame, users: DataFrame) -> DataFrame:
    """Matrix rows of the given users."""
    return matrix.join(users.select("user_idx"), "user_idx", "left_semi")


def _block_product(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial sums of one (row block, column block, column block) cell."""
    empty = pa.table({n: pa.array([], t) for n, t in
                      (("a", pa.int64()), ("b", pa.int64()), ("product", pa.float64()))})
    if not left.num_rows or not right.num_rows:
        return empty
    keys = np.unique(np.concatenate([left["key"].to_numpy(), right["key"].to_numpy()]))
    def dense(table):
        ids = table["id"].to_numpy()
        names, columns = np.unique(ids, return_inverse=True)
        cells = np.zeros((len(keys), len(names)))
        cells[np.searchsorted(keys, table["key"].to_numpy()), columns] = table["weight"].to_numpy()
        return names, cells
    a, x = dense(left)
    b, y = dense(right)
    product = x.T @ y
    i, j = np.nonzero(product)
    keep = a[i] < b[j]
    i, j = i[keep], j[keep]
    return pa.table({"a": a[i], "b": b[j], "product": product[i, j]})


def pair_products(
    matrix: DataFrame, key: str, ident: str, wide: int = WIDE, block: int = BLOCK
) -> DataFrame:
    """``(a, b, product)`` with a < b: Σ over ``key`` of weight(a)·weight(b).

    Keys with up to ``wide`` partners are joined with themselves, at most
    wide² rows each, and summed before the shuffle.  Wider keys are cut into
    blocks of keys × partners × partners: each cell is one bounded NumPy
    product that leaves the task already summed over its keys, so one key
    that meets a third of all partners is spread over many tasks.  A cell of
    the table goes to the blocks of its own key's partners only: a key with d
    partners copies each at most min(d, ids / block) times.
    """
    rows = matrix.where(F.col("weight") != 0)
    rows = rows.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.col("weight").cast("double").alias("weight"))
    wide_keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > wide).select("key")
    usual = rows.join(wide_keys, "key", "left_anti")
    left = usual.select("key", F.col("id").alias("a"), F.col("weight").alias("w"))
    right = usual.select("key", F.col("id").alias("b"), F.col("weight").alias("v"))
    narrow = left.join(right, "key").where(F.col("a") < F.col("b")).groupBy("a", "b")
    narrow = narrow.agg(F.sum(F.col("w") * F.col("v")).alias("product"))
    large = rows.join(wide_keys, "key", "left_semi")
    # Ids are dense, so a block of ids never holds more than `block` of them.
    large = large.withColumn("kb", F.floor(F.col("key") / block)).withColumn("ib", F.floor(F.col("id") / block))
    partners = large.groupBy("key").agg(F.collect_set("ib").alias("_blocks"))
    large = large.join(partners, "key")
    own = ["key", "id", "weight", "kb"]
    first = large.select(*own, "ib", F.explode(F.filter("_blocks", lambda b: b >= F.col("ib"))).alias("jb"))
    # Both sides come from one table; new names keep their columns apart.
    second = large.select(*[F.col(c).alias(c) for c in own], F.col("ib").alias("jb"), "_blocks")
    second = second.select(*own, "jb", F.explode(F.filter("_blocks", lambda b: b <= F.col("jb"))).alias("ib"))
    cell = ["kb", "ib", "jb"]
    blocks = first.groupBy(*cell).cogroup(second.groupBy(*cell))
    blocks = blocks.applyInArrow(_block_product, "a long, b long, product double")
    return narrow.unionByName(blocks).groupBy("a", "b").agg(F.sum("product").alias("product"))


def lengths(matrix: DataFrame, ident: str) -> DataFrame:
    return matrix.groupBy(F.col(ident).alias("id")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))


def pair_cosines(matrix: DataFrame, key: str, ident: str, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """``(a, b, similarity)`` with a < b for all pairs that share a key; other pairs have cosine 0."""
    length = lengths(matrix, ident)
    pairs = pair_products(matrix, key, ident, wide, block)
    pairs = pairs.join(length.select(F.col("id").alias("a"), F.col("length").alias("la")), "a")
    pairs = pairs.join(length.select(F.col("id").alias("b"), F.col("length").alias("lb")), "b")
    return pairs.select("a", "b", (F.col("product") / (F.col("la") * F.col("lb"))).alias("similarity"))


def item_similarity(matrix: DataFrame, **how) -> DataFrame:
    """Item–item cosine over users, each unordered pair once."""
    return pair_cosines(matrix, "user_idx", "item_idx", **how)


def user_similarity(matrix: DataFrame, wide: int = WIDE, block: int = BLOCK) -> DataFrame:
    """User–user cosine over items, each unordered pair once: up to as many rows as pairs of users, of which none is shuffled.

    Whole rows of users meet in blocks of ``block``; no user is joined by items, so ``wide`` changes nothing.
    """
    from basketflow.operators.neighbors import row_cosines

    return row_cosines(matrix, "user_idx", "item_idx", block)


def both_directions(pairs: DataFrame, diagonal: DataFrame | None = None) -> DataFrame:
    """Each pair as (a, b) and (b, a); with ``diagonal`` ids also (a, a) at 1."""
    turned = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "similarity")
    full = pairs.select(F.inline(F.array(turned("a", "b"), turned("b", "a"))))
    if diagonal is None:
        return full
    own = diagonal.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return full.unionByName(own)
