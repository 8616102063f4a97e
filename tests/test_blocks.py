"""Search, history vectors and features in blocks that meet without an exchange of vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketflow.operators import ranking, retrieval

SCHEMA = "item_idx long, vector array<float>"


def _items(spark, n=300, dim=8, seed=0):
    values = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    values[1::3] = values[0]  # a large group of copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(values)]
    return values.astype(np.float64), spark.createDataFrame(rows, SCHEMA).repartition(5)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _best(scores, k):
    rounded = np.round(scores, 9)
    return np.lexsort((np.arange(len(rounded)), -rounded))[:k].tolist()


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("sizes", [{}, {"query_block": 7, "item_block": 16}])
def test_search_of_copies_and_zero_vectors(spark, metric, sizes, monkeypatch):
    monkeypatch.setattr(retrieval, "TASK_ITEMS", 100)  # several parts of the items
    values, items = _items(spark)
    asked = np.vstack([values[:40], np.zeros((2, 8)), -values[:3]])
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, vector array<double>")
    got = {}
    for r in retrieval.nearest_items(queries, items, 5, metric, **sizes).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_idx)
    unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(-1, keepdims=True)), 1e-8)
    if metric == "l2":
        scores = -np.sqrt(np.maximum((asked**2).sum(1)[:, None] + (values**2).sum(1) - 2 * asked @ values.T, 0))
    else:
        scores = unit(asked) @ unit(values).T if metric == "cosine" else asked @ values.T
    assert got == {i: _best(s, 5) for i, s in enumerate(scores)}


def test_every_score_and_lists_of_different_lengths(spark):
    values, items = _items(spark, 30)
    queries = items.select(F.col("item_idx").alias("query_id"), "vector")
    every = retrieval.block_scores(queries, items, None, "dot", query_block=4, item_block=7).collect()
    assert len(every) == 900
    assert all(abs(r.score - values[r.query_id] @ values[r.item_idx]) < 1e-6 for r in every)
    wanted = queries.withColumn("want", F.col("query_id") % 4)
    counts = {r.query_id: r["count"] for r in retrieval.block_scores(wanted, items, 1).groupBy("query_id").count().collect()}
    assert counts == {i: i % 4 for i in range(30) if i % 4}


def test_vectors_are_not_exchanged(spark):
    _, items = _items(spark)
    queries = spark.createDataFrame([(q, [q % 7, 290, 999], 3, [1, 2, 999]) for q in range(50)], "query_id long, history array<long>, pos_item_idx long, cands array<long>")
    for df in (retrieval.history_vectors(queries, items), ranking.pair_features(queries, items), retrieval.block_scores(
            items.select(F.col("item_idx").alias("query_id"), "vector"), items, 3)):
        plan = _plan(df)
        assert "CartesianProduct" in plan and "CoGroup" not in plan
        assert not [line for line in plan.splitlines() if "Join" in line and "vector" in line]


def test_repeated_queries_and_items_count_each_time(spark):
    """Rows of one query_id are one query with all their items; an item that comes twice counts twice."""
    items = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], SCHEMA)
    queries = spark.createDataFrame(
        [(5, [0], 1, [1, 9]), (5, [1, None], 1, [0]), (6, [2, 8], 0, [0, 2])], "query_id long, history array<long>, pos_item_idx long, cands array<long>")
    got = {r.query_id: r.vector for r in retrieval.history_vectors(queries, items, keep_empty=True).distinct().collect()}
    assert np.allclose(got[5], np.array([2, 1]) / np.sqrt(5)) and got[6] == [0.0, 0.0]
    rows = sorted((r.query_id, r.item_idx, r.slot, round(r.dot_uv, 6), r.max_sim_recent, r.label) for r in ranking.pair_features(queries, items).collect())
    near = round(2 / np.sqrt(5), 6)
    assert rows == [
        (5, 0, 0, near, 1.0, 0.0), (5, 0, 0, near, 1.0, 0.0), (5, 1, 0, round(1 / np.sqrt(5), 6), 1.0, 1.0), (5, 9, 1, 0.0, 0.0, 0.0),
        (6, 0, 0, 0.0, 0.0, 1.0), (6, 0, 0, 0.0, 0.0, 1.0), (6, 2, 1, 0.0, 0.0, 0.0),
    ]


def test_features_without_any_vector(spark):
    items = spark.createDataFrame([], SCHEMA)
    queries = spark.createDataFrame([(1, [0], 4, [3, 4])], "query_id long, history array<long>, pos_item_idx long, cands array<long>")
    rows = [(r.item_idx, r.slot, r.dot_uv, r.label) for r in ranking.pair_features(queries, items).orderBy("slot").collect()]
    assert rows == [(3, 0, 0.0, 0.0), (4, 1, 0.0, 1.0)]


def test_table_of_all_scores_sends_only_scores(spark):
    values, items = _items(spark, 50)
    queries = items.select(F.col("item_idx").alias("query_id"), "vector")
    table = retrieval.similarity_table(queries, items, "dot", query_block=4, item_block=7, emitted=5)
    assert "CartesianProduct" in _plan(table)
    rows = table.collect()
    assert len(rows) == len({(r.query_id, r.item_idx) for r in rows}) == 2500
    assert all(abs(r.score - values[r.query_id] @ values[r.item_idx]) < 1e-6 for r in rows)
