"""Candidates of histories in two meetings with the catalog, and rankers that keep their best rows as they score."""

import numpy as np
import pytest

from basketflow.operators import ranking as R, retrieval as S, scoring, serving


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def vectors(spark):
    draw = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(x) for x in draw.normal(size=4)]) for i in range(40)], "item_idx long, vector array<double>")


QUERIES = [(1, [1, 2]), (2, [3, 99]), (3, [98, 99]), (4, []), (5, [7, 7, 8]), (5, [9]), (6, [None, 4]), (None, [1])]


@pytest.fixture
def queries(spark):
    rows = [(q, h, 30 + i, i) for i, (q, h) in enumerate(QUERIES)]
    return spark.createDataFrame(rows, "query_id long, history array<long>, pos_item_idx long, ts long")


def test_candidates_send_and_write_no_vector_of_a_query(spark, vectors, queries, monkeypatch):
    written, own = [], S.settle
    monkeypatch.setattr(S, "settle", lambda df: written.append(set(df.columns)) or own(df))
    lists = S.candidate_lists(queries, vectors, 6)
    assert not any({"query_id", "vector"} <= columns for columns in written)
    sent = [line for line in plan(lists).splitlines() if "Exchange" in line]
    assert len(sent) == 1 and "Join" not in plan(lists)
    # as by the single steps: rows of one id are one query, which has each item once per row
    usual = S.nearest_lists(S.history_vectors(queries, vectors, keep_empty=True), vectors, 6)
    want = queries.join(usual, "query_id").withColumn("cands", S.force_positive(S.F.col("cands"), S.F.col("pos_item_idx")))
    shown = lambda df: sorted(map(str, df.select("query_id", "history", "pos_item_idx", "cands", "ts").collect()))
    assert shown(lists) == shown(want) and lists.count() == 7


def test_cells_give_lists_without_a_row_per_item(spark, vectors, queries):
    index, once = S.CellIndex.build(vectors, 5), queries.where("query_id <> 5")
    found = S.with_nearest(once, vectors, 6, index=index, probes=2)
    assert "Window" not in plan(found) and "Join" not in plan(found)
    usual = S.nearest_lists(S.history_vectors(once, vectors), vectors, 6, index=index, probes=2)
    assert {r.query_id: r.cands for r in found.collect()} == {r.query_id: r.cands for r in usual.collect()}
    # cells with too few items: the exact list
    wide = S.with_nearest(once, vectors, 30, index=index, probes=1).collect()
    exact = {r.query_id: r.cands for r in S.with_nearest(once, vectors, 30).collect()}
    assert {r.query_id: r.cands for r in wide} == exact and {len(r.cands) for r in wide} == {30}


def test_rankers_keep_what_can_be_among_their_best(spark):
    draw = np.random.default_rng(2)
    rows = [(q, i, *(float(x) for x in draw.integers(-2, 3, size=5))) for q in (1, 2, None) for i in range(50)]
    rows += [(3, i, 1.0, 1.0, float("nan") if i == 4 else 0.0, 0.0, 0.0) for i in range(4)] + [(3, 4, 1.0, 1.0, float("nan"), 0.0, 0.0)]
    features = spark.createDataFrame(rows, "query_id long, item_idx long, " + ", ".join(f"{c} double" for c in R.FEATURES))
    rankers = {"first": lambda x: x[:, 0] + x[:, 1] / 3, "second": lambda x: x[:, 2] - 1e-12 * x[:, 3]}
    best = scoring.best_scored(features, rankers, 3)
    assert 0 < best.count() < features.count()
    for name, ranker in rankers.items():
        shown = lambda df: sorted(map(str, R.rerank(df.select("query_id", "item_idx", "score"), 3).collect()))
        mine = best.where(best[name].isNotNull()).withColumnRenamed(name, "score")
        assert shown(mine) == shown(scoring.score_features(features, ranker))


def test_customers_lists_are_made_without_vectors_sent(spark, vectors, monkeypatch):
    lines = spark.createDataFrame([(c, f"{i}", f"2024-01-{1 + i:02d}") for c in (1, 2) for i in range(5)], "customer_id long, stock_code string, invoice_date string")
    codes = spark.createDataFrame([(f"{i}", i) for i in range(40)], "stock_code string, item_idx long")
    written = []
    own = S.settle
    monkeypatch.setattr(S, "settle", lambda df: written.append(set(df.columns)) or own(df))
    scorer = lambda f: scoring.best_scored(f, {"score": lambda x: x[:, 0]}, 3)
    found = serving.recommend_customers(lines, codes, codes, vectors, scorer, 3, 10)
    assert found.count() == 6 and not any({"query_id", "vector"} <= columns for columns in written)
