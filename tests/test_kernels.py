"""What tasks do per pair, per row and per value: held keys, products of features, rounding; and what prices are made of."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketflow.functions.rounding import rounded
from basketflow.functions.vectors import list_column, unit_rows
from basketflow.operators import clean, ranking, retrieval as R, tables as T


def searched(metric, queries, items, ids, want, size=37):
    best = R._Best(metric, pa.table({"query_id": np.arange(len(queries)), "want": want, "vector": list_column(queries)}))
    for at in range(0, len(ids), size):
        best.add(pa.table({"item_idx": ids[at:at + size], "vector": list_column(items[at:at + size])}))
    found = {}
    for batch in best.end():
        for q, i, s in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            found.setdefault(q, []).append((i, s))
    return found, best


def brute(metric, queries, items, ids, want):
    queries, items = (unit_rows(queries), unit_rows(items)) if metric == "cosine" else (queries, items)
    scores, out = np.round(queries @ items.T, 9) + 0.0, {}
    for q, row in enumerate(scores):
        order = np.lexsort((ids, -row))[: want[q]]
        if len(order):
            out[q] = [(int(ids[i]), float(row[i])) for i in order]
    return out


@pytest.fixture
def drawn():
    draw = np.random.default_rng(4)
    items, queries = draw.integers(-2, 3, (400, 3)).astype(float), draw.integers(-2, 3, (300, 3)).astype(float)
    return queries, items, draw.permutation(400).astype(np.int64)


@pytest.mark.parametrize("want", [np.full(300, 12), np.arange(300) % 9, np.full(300, 1_000)])
def test_search_holds_keys_and_sorts_no_triples(monkeypatch, drawn, want):
    queries, items, ids = drawn
    expected = brute("cosine", queries, items, ids, want)
    monkeypatch.setattr(R.np, "lexsort", None)  # three sorts of all that is held, per block of items
    found, best = searched("cosine", queries, items, ids, want)
    assert best.packed and found == expected


@pytest.mark.parametrize("shift, metric", [(-7, "cosine"), (2**32 - 200, "cosine"), (0, "dot")])
def test_search_holds_triples_where_keys_do_not_fit(drawn, shift, metric):
    queries, items, ids = drawn
    want = np.full(300, 12)
    found, best = searched(metric, queries, items, ids + shift, want)
    assert not best.packed and found == brute(metric, queries, items, ids + shift, want)


def test_lists_of_very_different_lengths_are_no_table(drawn):
    queries, items, ids = drawn
    want = np.where(np.arange(300) == 3, 1_000_000, 2)
    found, best = searched("cosine", queries, items, ids, want)
    assert not best.packed and found == brute("cosine", queries, items, ids, want)


def test_features_read_a_candidate_once(monkeypatch):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(50, 4)).astype(np.float32)
    vectors[7] = 0
    hist, cands = [[1, 2, 3, 60], [], [61], [7, 7, 9]], [[4, 7, 70, 1], [5], [6, 4], [9, 7, 71]]
    block = pa.table({
        "query_id": np.arange(4), "pos_item_idx": [7, 5, 4, 0], "n_hist": [4, 0, 1, 3], "hist": pa.array(hist, pa.list_(pa.int64())),
        "items": pa.array(cands), "slots": pa.array([list(range(len(c))) for c in cands])})
    shapes, own = [], np.einsum
    monkeypatch.setattr(ranking.np, "einsum", lambda *a, **k: shapes.append(a[1].shape[0]) or own(*a, **k))
    state = ranking._PairFeatures(15, ("pop",), block)
    for at in (30, 0):  # blocks in any order
        ids = np.arange(at, min(at + 30, 50))
        state.add(pa.table({"item_idx": ids, "vector": list_column(vectors[ids])}))
    state.add(pa.table({"item_idx": [4, 4, 9], "pop": [0.5, 0.25, 0.75]}))
    rows = [r for batch in state.end() for r in pa.Table.from_batches([batch]).to_pylist()]
    assert sum(shapes) <= sum(map(len, cands))  # not once per item of a history
    doubles = vectors.astype(float)
    known = lambda items: doubles[[i for i in items if i < 50]]
    want = []
    for q, (h, c) in enumerate(zip(hist, cands, strict=True)):
        units = unit_rows(known(h))
        mean = unit_rows(known(h).mean(axis=0, keepdims=True))[0] if len(units) else np.zeros(4)
        for slot, i in enumerate(c):
            v = doubles[i] if i < 50 else np.zeros(4)
            near = max(units @ unit_rows(v[None])[0], default=0.0)
            for pop in {4: [0.5, 0.25], 9: [0.75]}.get(i, [0.0]):
                want.append((q, i, slot, float(mean @ v), float(near), len(h) / 15, pop, float(i == [7, 5, 4, 0][q])))
    names = ("query_id", "item_idx", "slot", "dot_uv", "max_sim_recent", "hist_len", "pop", "label")
    assert len(rows) == len(want)
    for row, expected in zip(rows, want, strict=True):
        assert [row[n] for n in names] == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("digits", [6, 9])
def test_rounding_is_that_of_spark(spark, digits):
    draw = np.random.default_rng(8)
    halves = (draw.integers(-(10**6), 10**6, 2_000) * 10 + 5) / 10.0 ** (digits + 1)
    odd = [0.0, -0.0, -1e-12, math.nan, math.inf, -math.inf, 1e308, 5e-7, -5e-10, 1e5 + 0.1, 123456789.1234565, None]
    values = [*map(float, halves), *map(float, draw.normal(size=2_000)), *odd]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    pairs = rows.select("v", F.round("v", digits).cast("string").alias("a"), rounded(F.col("v"), digits).cast("string").alias("b"))
    assert pairs.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == []


def test_prices_are_made_without_texts(spark, data, monkeypatch):
    from basketflow.catalog import views as V

    written, own = [], clean.settle
    monkeypatch.setattr(clean, "settle", lambda df: written.append(df) or own(df))
    rows = V.clean_prices(spark, data)
    merged, = written
    assert set(merged.columns) == {*clean.MERGE_KEYS, *clean.MEASURES}
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan  # texts have no place in a hash table of sums
    sent = next(line for line in plan[plan.index("REPARTITION_BY_COL"):].splitlines() if "Project [" in line)
    assert "pythonUDF" not in sent  # the normalised text is needed for the rule on products alone
    prices = lambda items: {tuple(r) for r in items.select("stock_code", "price_median", "price_mean", "popularity").collect()}
    assert prices(T.item_catalog(rows, ())) == prices(T.item_catalog(V.clean(spark, data)))


def test_perceptron_scores_batches_and_reads_its_rows_once(spark, monkeypatch):
    from pyspark.ml.functions import vector_to_array

    from basketflow.operators import scoring

    draw = np.random.default_rng(9)
    columns = ", ".join(f"{c} double" for c in ranking.FEATURES)
    rows = spark.createDataFrame([(*map(float, draw.normal(size=5) * 9), float(i % 3 == 0)) for i in range(300)], f"{columns}, label double")
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    model = scoring.fit_ranker(rows.mapInArrow(counted, rows.schema), (6, 4), iterations=5)
    assert made.value == 300
    usual = model.transform(rows).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")
    found = scoring.score_with(model, rows)
    assert found.columns == usual.columns and "UDF" not in found._jdf.queryExecution().executedPlan().toString()
    assert np.allclose(np.array(found.collect()), np.array(usual.collect()), rtol=0, atol=1e-12)
    nothing = spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 0.0)], rows.schema)
    with pytest.raises(Exception, match="null or NaN"):
        scoring.score_with(model, nothing).collect()


def test_only_rows_that_can_be_listed_are_sorted(spark):
    from basketflow.operators import evaluate, scoring

    draw = np.random.default_rng(10)
    rows = [(q, i, float(draw.integers(0, 9)), float(i == 3)) for q in (1, 2, None) for i in range(60)]
    rows += [(3, i, None if i == 2 else math.nan, float(i == 2)) for i in range(60)]
    scored = spark.createDataFrame(rows, "query_id long, item_idx long, score double, label double").coalesce(1)
    assert 0 < scoring.among_best(scored, 2).where("query_id IS NOT NULL AND query_id < 3").count() < 100
    for k in (1, 2, 60):
        hits = 0
        for q in (1, 2, None, 3):
            own = [r for r in rows if r[0] == q]
            order = sorted(own, key=lambda r: (math.inf if r[2] is None else -math.inf if math.isnan(r[2]) else -r[2], r[1]))
            hits += any(r[3] for r in order[:k])
        assert evaluate.recall_from_scores(scored, k).first()["recall"] == hits / 4


def test_evaluation_scores_keep_what_is_listed(spark):
    from basketflow.catalog import evaluating, views as V

    draw = np.random.default_rng(11)
    rows = [(1, i, *map(float, draw.normal(size=5))) for i in range(200)]
    features = spark.createDataFrame(rows, "query_id long, item_idx long, " + ", ".join(f"{c} double" for c in ranking.FEATURES)).coalesce(1)
    most = max(V.KS)
    found = evaluating.scorer(features)
    assert most <= found.count() < 200
    from basketflow.operators.scoring import score_features

    lists = lambda scored: sorted(map(str, ranking.rerank(scored, most).collect()))
    assert lists(found) == lists(score_features(features, V.dense_ranker()))
