"""Lists that stay lists: features without a join by item, candidates, mixes and cells without a row per item sent."""

import numpy as np
import pytest

from basketflow.operators import baselines as B, evaluate as E, ranking as R, retrieval as S
from basketflow.operators.graph import pair_scores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(30)]
    return spark.createDataFrame(rows, "item_idx long, vector array<double>")


def test_lookups_come_along_with_the_vectors(spark, vectors):
    queries = spark.createDataFrame([(1, [1, 2], 5, [5, 6, 99])], "query_id long, history array<long>, pos_item_idx long, cands array<long>")
    pop = spark.createDataFrame([(6, 0.25), (5, None), (99, 0.5), (None, 9.0)], "item_idx long, pop double")
    price = spark.createDataFrame([(5, 1.0), (6, 2.0), (5, 3.0)], "item_idx long, price_z double")
    found = R.build_features(queries, vectors, pop, price)
    assert "SortMergeJoin" not in plan(found) and "HashJoin" not in plan(found)
    rows = sorted((r.item_idx, r.slot, r.pop, r.price_z) for r in found.collect())
    assert rows == [(5, 0, 0.0, 1.0), (5, 0, 0.0, 3.0), (6, 1, 0.25, 2.0), (99, 2, 0.5, 0.0)]


def test_candidates_are_sent_as_lists(spark, vectors, monkeypatch):
    queries = vectors.withColumnRenamed("item_idx", "query_id")
    usual = {r.query_id: r.cands for r in S.as_lists(S.nearest_items(queries, vectors, 7)).collect()}
    for items in (S.TASK_ITEMS, 8):  # one part of the items, and several
        monkeypatch.setattr(S, "TASK_ITEMS", items)
        lists = S.nearest_lists(queries, vectors.repartition(5), 7)
        assert "Window" not in plan(lists)
        assert {r.query_id: r.cands for r in lists.collect()} == usual


def test_mixed_lists_keep_the_lowest_candidates_without_a_score(spark):
    queries = spark.createDataFrame([(1, [9, 3, 4, 8, 9]), (2, [2, 1])], "query_id long, cands array<long>")
    ranked = {
        "a": spark.createDataFrame([(1, 8, 2.0), (1, 4, -1.0), (1, 77, 5.0)], "query_id long, item_idx long, score double"),
        "b": spark.createDataFrame([(1, 8, 4.0)], "query_id long, item_idx long, score double"),
    }
    mixed = R.mix_rankers(queries, ranked, 3)
    assert "Generate explode(" not in plan(mixed)
    assert sorted((r.query_id, r["rank"], r.item_idx, r.score) for r in mixed.collect()) == [
        (1, 1, 8, 1.5), (1, 2, 3, 0.0), (1, 3, 9, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0)]


def test_cells_give_a_list_per_query_not_per_cell(spark, vectors):
    index = S.CellIndex.build(vectors, 6)
    queries = vectors.withColumnRenamed("item_idx", "query_id")
    exact = {(r.query_id, r["rank"]): (r.item_idx, r.score) for r in S.nearest_items(queries, vectors, 5).collect()}
    found = S.nearest_by_cell(queries, index, 5, 6)
    assert "CoGroup" not in plan(found)
    assert {(r.query_id, r["rank"]): (r.item_idx, r.score) for r in found.collect()} == exact
    # few cells: only items of the probed ones, unless the list is short
    cell = {r.item_idx: r.cell for r in index.vectors.collect()}
    one = S.nearest_by_cell(queries, index, 1, 1).collect()
    assert len(one) == 30 and all(cell[r.item_idx] == cell[r.query_id] for r in one)


def test_pairs_are_scored_without_a_vector_per_pair(spark, vectors):
    units = S.unit_vectors(vectors)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 2), (4, 99), (50, 1)], "query_id long, item_idx long")
    scored = pair_scores(pairs, units.withColumnRenamed("item_idx", "query_id"), units, 30)
    assert "CoGroup" not in plan(scored)
    unit = {r.item_idx: np.array(r.vector) for r in units.collect()}
    want = {(q, i): round(float(unit[q] @ unit[i]), 9) for q, i in ((1, 2), (1, 3), (4, 2))}
    assert {(r.query_id, r.item_idx): r.score for r in scored.collect()} == pytest.approx(want)


def test_lists_that_pack_well_are_not_broadcast(spark, tmp_path):
    """Their file is smaller than the limit for a broadcast, however many rows it holds."""
    path = str(tmp_path / "lists")
    spark.range(100_000).selectExpr("'m' AS model", "id div 20 AS query_id", "id % 20 + 1 AS rank", "id % 20 AS item_idx").write.parquet(path)
    read = spark.read.parquet(path)
    truths = spark.range(10_000).selectExpr("id AS query_id", "3L AS truth")
    ranks = E.truth_ranks(read, truths, ["m"])
    assert "SortMergeJoin [query_id" in plan(ranks)
    assert ranks.where("hit = 4").count() == 5_000 and ranks.count() == 10_000
    matrix = read.selectExpr("query_id AS user_idx", "item_idx", "1.0D AS weight")
    users = matrix.select("user_idx").distinct()
    assert "SortMergeJoin [user_idx" in plan(B.recommend_popular(matrix, users, 2))


@pytest.mark.parametrize("name", ["r16_order_kept_without_scores", "r17_rankers_max"])
def test_feature_rows_are_not_written(spark, data, monkeypatch, name):
    from basketflow import session
    from basketflow.catalog import QUERIES, load, ranking, views

    load()
    written = []
    for module in (ranking, views, R, S):
        monkeypatch.setattr(module, "settle", lambda df: written.append(set(df.columns)) or session.settle(df))
    ranking._PRICES.clear()
    assert QUERIES[name](spark, data).count() > 0
    assert not any({"dot_uv", "slot"} & columns for columns in written)
    # the candidates are made once, and the clean lines are not written a second time beside the merged ones
    assert sum("cands" in columns for columns in written) == 1 and not any("stock_code" in columns for columns in written)
