"""Recommenders that need only the user × item table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.functions.vectors import SCORE_DIGITS
from basketflow.operators.factorize import Factors, factorize
from basketflow.operators.matrix import both_directions, lengths
from basketflow.operators.neighbors import nearest_rows, profiles, sparse_products
from basketflow.operators.ordering import row_index
from basketflow.operators.retrieval import block_scores, top_items

KNN_NEIGHBORS = 50
POP_ALPHA = 0.01


def popularity(matrix: DataFrame) -> DataFrame:
    """``(item_idx, pop)``: column sums."""
    return matrix.groupBy("item_idx").agg(F.sum("weight").alias("pop"))


def scaled_popularity(matrix: DataFrame) -> DataFrame:
    """``(item_idx, pop)`` over the largest column sum, when that is positive."""
    pop = popularity(matrix)
    top = pop.agg(F.max("pop")).scalar()
    return pop.withColumn("pop", F.when(top > 0, F.col("pop") / top).otherwise(F.col("pop")))


def ranked_popularity(pop: DataFrame) -> DataFrame:
    """Adds ``pop_rank`` 0, 1, …: higher popularity first, then lower item."""
    return row_index(pop, [F.col("pop").desc(), F.col("item_idx")], "pop_rank")


def most_popular(items: DataFrame, n: int) -> DataFrame:
    """The n items a customer without history is shown, with ``popularity`` and item_idx."""
    return items.orderBy(F.col("popularity").desc(), "item_idx").limit(n)


def seen_by(users: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(user_idx, item_idx)`` of items not to recommend."""
    cells = matrix.where(F.col("weight") != 0).select("user_idx", "item_idx")
    return cells.join(users.select("user_idx"), "user_idx", "left_semi")


def without_seen(rows: DataFrame, seen: DataFrame, key: str = "user_idx") -> DataFrame:
    """Rows (key, item_idx, …) that are not in ``seen``, whose files are far smaller than its rows: it is merged, not broadcast."""
    return rows.join(seen.hint("merge"), [key, "item_idx"], "left_anti")


def enough_popular(users: DataFrame, ranked: DataFrame, seen: DataFrame, k: int, key: str) -> DataFrame:
    """Per user the (k + seen) most popular items: at least k of them are unseen.

    Rows grow with users·k plus the matrix size, never with users × items.
    """
    count = seen.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    wanted = users.select(key).distinct().join(count, key, "left")
    ranks = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_n"), F.lit(0)) + (k - 1))
    return wanted.select(key, F.explode(ranks).alias("pop_rank")).join(ranked, "pop_rank").select(key, "item_idx", "pop")


def recommend_popular(
    matrix: DataFrame, users: DataFrame, k: int, seen: DataFrame | None = None, key: str = "user_idx"
) -> DataFrame:
    """k most popular unseen items per user; with key 'query_id' a query's ``truth`` counts as unseen.

    Queries share the list of their user, to which the truth is added where
    the user has seen it: users·k + queries·(k + 1) rows, whatever was seen.
    """
    if key == "query_id":
        people = users.select("user_idx").distinct()
        lists = recommend_popular(matrix, people, k).select("user_idx", "item_idx", "score")
        pop = popularity(matrix).select(F.col("item_idx").alias("truth"), F.col("pop").alias("score"))
        known = matrix.where(F.col("weight") != 0).select("user_idx", F.col("item_idx").alias("truth"))
        held = users.select(key, "user_idx", "truth").join(known, ["user_idx", "truth"], "left_semi").join(pop, "truth")
        rows = users.select(key, "user_idx").join(lists, "user_idx").select(key, "item_idx", "score")
        return top_items(rows.unionByName(held.select(key, F.col("truth").alias("item_idx"), "score")), k, key)
    seen = seen_by(users, matrix) if seen is None else seen
    rows = enough_popular(users, ranked_popularity(popularity(matrix)), seen, k, key)
    rows = without_seen(rows, seen, key).withColumnRenamed("pop", "score")
    return top_items(rows, k, key)


def recommend_item_knn(
    profile: DataFrame,
    similarity: DataFrame,
    matrix: DataFrame,
    k: int,
    alpha: float = POP_ALPHA,
    seen: DataFrame | None = None,
    key: str = "user_idx",
    users: DataFrame | None = None,
    **blocks,
) -> DataFrame:
    """k unseen items by Σ profile weight · similarity + alpha · scaled popularity.

    ``profile`` has (key, item_idx, weight); seen defaults to the profile's
    items.  ``users`` (key) defaults to those with a profile; one without a
    profile is ranked by the popularity term alone.  Profiles meet blocks of
    similarity columns; of each block the k + (number seen) best items leave,
    so k unseen ones are among them: users · (k + seen) · blocks rows at most.
    """
    seen = profile.where(F.col("weight") > 0).select(key, "item_idx") if seen is None else seen.select(key, "item_idx").distinct()
    people = (profile if users is None else users).select(key).distinct()
    counts = seen.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("_seen"))
    nothing = lambda kind: F.array().cast(f"array<{kind}>")
    left = people.withColumnRenamed(key, "id").join(profiles(profile, key, "item_idx"), "id", "left").join(counts, "id", "left")
    left = left.select("id", (F.coalesce("_seen", F.lit(0)) + k).alias("want"), F.coalesce("keys", nothing("bigint")).alias("keys"),
                       F.coalesce("weights", nothing("double")).alias("weights"))
    full = both_directions(similarity, lengths(matrix, "item_idx"))
    right = full.select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("similarity").alias("value"))
    if alpha:
        popular = scaled_popularity(matrix).select(F.lit(None).cast("long").alias("key"), F.col("item_idx").alias("id"), (alpha * F.col("pop")).alias("value"))
        right = right.unionByName(popular)
    found = sparse_products(left, right, **blocks)
    rows = found.select(F.col("id").alias(key), F.col("other").alias("item_idx"), F.round("score", SCORE_DIGITS).alias("score"))
    return top_items(without_seen(rows, seen, key), k, key)


def nearest_users(matrix: DataFrame, users: DataFrame, n: int = KNN_NEIGHBORS, **blocks) -> DataFrame:
    """``(user_idx, neighbor, similarity, rank)``: the n most similar other users, similarity above 0."""
    return nearest_rows(matrix, users, n, **blocks)


def recommend_user_knn(
    matrix: DataFrame,
    users: DataFrame,
    k: int,
    neighbors: int = KNN_NEIGHBORS,
    seen: DataFrame | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """k unseen items by Σ similarity · weight over each user's nearest users (``near``, default those of the matrix)."""
    near = nearest_users(matrix, users, neighbors) if near is None else near
    rows = matrix.select(F.col("user_idx").alias("neighbor"), "item_idx", "weight")
    scored = near.select("user_idx", "neighbor", "similarity").join(rows, "neighbor").groupBy("user_idx", "item_idx")
    scored = scored.agg(F.round(F.sum(F.col("similarity") * F.col("weight")), SCORE_DIGITS).alias("score"))
    seen = seen_by(users, matrix) if seen is None else seen
    return top_items(without_seen(scored.where(F.col("score") > 0), seen), k, "user_idx")


def recommend_factors(
    matrix: DataFrame, users: DataFrame, k: int, rank: int = 50, seed: int = 42, rounds: int = 40, tolerance: float = 1e-4
) -> DataFrame:
    """k unseen items by the product of non-negative factors of the whole table, zeros included.

    Users without a cell have no factors and no list.
    """
    return factor_lists(factorize(matrix, rank, rounds, tolerance=tolerance, seed=seed), matrix, users, k)


def factor_lists(factors: Factors, matrix: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """k unseen items per user by the product of its factors with those of the items; one model serves any users."""
    known = users.select("user_idx").distinct()
    vectors = factors.users.withColumnRenamed("user_idx", "query_id").join(known.withColumnRenamed("user_idx", "query_id"), "query_id", "left_semi")
    seen = seen_by(known, matrix).withColumnRenamed("user_idx", "query_id")
    more = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("_more"))
    vectors = vectors.join(more, "query_id", "left").withColumn("want", F.coalesce("_more", F.lit(0)) + k).drop("_more")
    scores = without_seen(block_scores(vectors, factors.items, k, "dot"), seen, "query_id")
    return top_items(scores, k).withColumnRenamed("query_id", "user_idx")


def for_queries(by_user: DataFrame, queries: DataFrame, model: str) -> DataFrame:
    """Lists found once per user, repeated for each query of that user."""
    return queries.select("query_id", "user_idx").join(by_user, "user_idx").select(
        F.lit(model).alias("model"), "query_id", "rank", "item_idx", "score"
    )
