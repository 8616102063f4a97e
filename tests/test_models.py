"""Matrices, baselines, retrieval, ranking and metrics against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketflow.operators import baselines as B, evaluate as E, matrix as M, ranking as K, retrieval as R, scoring as S
from basketflow.operators import objectives as O


def random_matrix(spark, users=60, items=40, share=0.3, seed=2):
    rng = np.random.default_rng(seed)
    cells = (rng.random((users, items)) < share) * rng.integers(1, 5, (users, items)) * 0.5
    cells[0, :] = 1.0  # one user that bought everything
    cells[:, 1] = 0.5  # one item that everyone bought
    rows = [(int(u), int(i), float(cells[u, i])) for u, i in zip(*np.nonzero(cells))]
    return spark.createDataFrame(rows, "user_idx long, item_idx long, weight double"), cells


def cosines(cells):
    lengths = np.linalg.norm(cells, axis=1)
    return cells @ cells.T / np.maximum(np.outer(lengths, lengths), 1e-12)


def best(scores, k):
    return sorted((i for i in range(len(scores)) if scores[i] > -1e9), key=lambda i: (-round(scores[i], 9), i))[:k]


def lists(df, key="user_idx"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append(r["item_idx"])
    return out


def test_matrix_sums_duplicates(spark):
    rows = spark.createDataFrame([(0, [7, 7], 7)], "user_idx long, history array<long>, pos_item_idx long")
    assert M.interaction_matrix(rows).first()["weight"] == 2.0


@pytest.mark.parametrize("wide,block", [(1000, 1024), (20, 8), (0, 16)])
def test_similarities(spark, wide, block):
    df, cells = random_matrix(spark)
    for got, want in ((M.item_similarity(df, wide=wide, block=block), cosines(cells.T)),
                      (M.user_similarity(df, wide=wide, block=block), cosines(cells))):
        rows = got.collect()
        assert len({(r["a"], r["b"]) for r in rows}) == len(rows) == int((np.triu(want, 1) > 1e-12).sum())
        assert all(r["a"] < r["b"] and abs(r["similarity"] - want[r["a"], r["b"]]) < 1e-9 for r in rows)


def test_popular(spark):
    df, cells = random_matrix(spark)
    users = spark.createDataFrame([(u,) for u in range(60)], "user_idx long")
    got = lists(B.recommend_popular(df, users, 5))
    pop = cells.sum(axis=0)
    for u in range(60):
        assert got.get(u, []) == best(np.where(cells[u] > 0, -1e12, pop), 5)


def test_popular_with_held_out_item(spark):
    df, cells = random_matrix(spark)
    queries = spark.createDataFrame([(100 + u, u, 1) for u in range(60)], "query_id long, user_idx long, truth long")
    got = lists(B.recommend_popular(df, queries, 5, key="query_id"), "query_id")
    pop = cells.sum(axis=0)
    for u in range(60):
        scores = np.where(cells[u] > 0, -1e12, pop)
        scores[1] = pop[1]
        assert got[100 + u] == best(scores, 5)


def test_item_knn(spark):
    df, cells = random_matrix(spark, share=0.05)
    got = lists(B.recommend_item_knn(df, M.item_similarity(df), df, 6))
    sim, pop = cosines(cells.T), cells.sum(axis=0) / cells.sum(axis=0).max()
    for u in range(60):
        scores = np.where(cells[u] > 0, -1e12, cells[u] @ sim + 0.01 * pop)
        assert got.get(u, []) == best(scores, 6)


def test_user_knn(spark):
    df, cells = random_matrix(spark)
    users = spark.createDataFrame([(u,) for u in range(60)], "user_idx long")
    got = lists(B.recommend_user_knn(df, users, 4, neighbors=7))
    sim = cosines(cells)
    for u in range(60):
        near = sorted((v for v in range(60) if v != u and sim[u, v] > 0), key=lambda v: (-round(sim[u, v], 9), v))[:7]
        scores = sum(sim[u, v] * cells[v] for v in near)
        assert got.get(u, []) == best(np.where((cells[u] > 0) | (scores <= 0), -1e12, scores), 4)


def test_factors_leave_out_seen_items(spark):
    df, cells = random_matrix(spark)
    users = spark.createDataFrame([(u,) for u in range(60)], "user_idx long")
    got = lists(B.recommend_factors(df, users, 5, rank=8))
    assert 0 not in got
    for u in range(1, 60):
        assert len(got[u]) == min(5, int((cells[u] == 0).sum())) and not (cells[u][got[u]] > 0).any()


# ---- vectors ----------------------------------------------------------------------------------
def random_vectors(spark, n, name, d=8, seed=5):
    v = np.random.default_rng(seed).normal(size=(n, d)).round(4)
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], f"{name} long, vector array<double>"), v


def unit(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_block_search_is_exact(spark, metric):
    q, qv = random_vectors(spark, 70, "query_id")
    items, iv = random_vectors(spark, 130, "item_idx", seed=6)
    scores = {"cosine": unit(qv) @ unit(iv).T, "dot": qv @ iv.T,
              "l2": -np.sqrt(((qv[:, None] - iv[None]) ** 2).sum(-1))}[metric]
    for sizes in ({}, {"query_block": 16, "item_block": 20}):
        got = lists(R.nearest_items(q, items, 7, metric, **sizes), "query_id")
        assert all(got[i] == best(scores[i], 7) for i in range(70))


def test_block_search_with_ties(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "item_idx long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert lists(R.nearest_items(q, items, 5, item_block=7), "query_id") == {1: [0, 1, 2, 3, 4]}


def test_one_table_on_both_sides(spark):
    df, v = random_vectors(spark, 40, "item_idx")
    got = R.similarity_table(df.withColumn("query_id", F.col("item_idx")), df, "dot").count()
    assert got == 1600


def test_unseen_items(spark):
    q, qv = random_vectors(spark, 30, "query_id")
    items, iv = random_vectors(spark, 60, "item_idx", seed=7)
    out = spark.createDataFrame([(i, j) for i in range(30) for j in range(i)], "query_id long, item_idx long")
    got = lists(R.unseen_items(q, items, out, 5, item_block=16), "query_id")
    scores = unit(qv) @ unit(iv).T
    for i in range(30):
        scores[i, :i] = -1e12
        assert got[i] == best(scores[i], 5)


def test_excluded_after_the_list_makes_it_shorter(spark):
    q, _ = random_vectors(spark, 10, "query_id")
    items, _ = random_vectors(spark, 20, "item_idx", seed=7)
    out = spark.createDataFrame([(i, j) for i in range(10) for j in range(10)], "query_id long, item_idx long")
    got = lists(R.retrieve_for_users(q, items, 5, out), "query_id")
    assert all(len(v) < 5 or min(v) >= 10 for v in got.values())


def test_hot_cell_and_hot_bucket(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(200, 6)) * 0.01 + 1, rng.normal(size=(100, 6))])
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "item_idx long, vector array<double>")
    q = items.withColumnRenamed("item_idx", "query_id")
    exact = lists(R.nearest_items(q, items, 5), "query_id")
    index = R.CellIndex.build(items, 8)
    assert lists(R.nearest_by_cell(q, index, 5, 8), "query_id") == exact
    few = lists(R.nearest_by_cell(q, index, 5, 4), "query_id")
    hashed = lists(R.nearest_by_hash(q, items, 5), "query_id")
    for found in (few, hashed):
        share = np.mean([len(set(found[i]) & set(exact[i])) / 5 for i in exact])
        assert share > 0.7
        assert all(i in found for i in exact)


def test_history_vectors(spark):
    items, iv = random_vectors(spark, 20, "item_idx")
    q = spark.createDataFrame([(1, [0, 1, 1]), (2, []), (3, [99]), (4, list(range(20)))], "query_id long, history array<long>")
    got = {r["query_id"]: r["vector"] for r in R.history_vectors(q, items, keep_empty=True).collect()}
    mean = lambda ids: unit(iv[ids].mean(axis=0, keepdims=True))[0]
    assert np.allclose(got[1], mean([0, 1, 1])) and np.allclose(got[4], mean(list(range(5, 20))))
    assert got[2] == got[3] == [0.0] * 8


def test_force_positive(spark):
    rows = spark.createDataFrame([(9,), (5,)], "pos long").withColumn("c", F.array(*[F.lit(x).cast("long") for x in (4, 5, 6)]))
    assert [r[0] for r in rows.select(R.force_positive(F.col("c"), F.col("pos"))).collect()] == [[4, 5, 9], [4, 5, 6]]


def test_mix_retrievers(spark):
    a = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 11, 0.5)], "query_id long, rank long, item_idx long, score double")
    b = spark.createDataFrame([(1, 1, 11, 1.0)], "query_id long, rank long, item_idx long, score double")
    got = [(r["item_idx"], r["score"]) for r in R.mix_retrievers({"a": a, "b": b}, 5).orderBy("rank").collect()]
    assert got == [(11, 0.75), (10, 0.5)]


def test_trained_vectors_have_length_one(spark):
    df, _ = random_matrix(spark)
    for table in R.trained_vectors(df, 8):
        assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in table.collect())


# ---- ranking ----------------------------------------------------------------------------------
def test_features(spark):
    items, iv = random_vectors(spark, 30, "item_idx")
    q = spark.createDataFrame([(1, [2, 3], 5, [2, 5, 7]), (2, [50], 1, [1]), (3, [4], 9, [4])],
                              "query_id long, history array<long>, pos_item_idx long, cands array<long>")
    pop = spark.createDataFrame([(5, 0.5)], "item_idx long, pop double")
    got = {(r["query_id"], r["item_idx"]): r for r in K.build_features(q, items, pop).collect()}
    u = unit(iv[[2, 3]].mean(axis=0, keepdims=True))[0]
    for i in (2, 5, 7):
        r = got[1, i]
        assert math.isclose(r["dot_uv"], iv[i] @ u) and math.isclose(r["hist_len"], 2 / 15)
        assert math.isclose(r["max_sim_recent"], (unit(iv)[i] @ unit(iv)[[2, 3]].T).max())
        assert r["pop"] == (0.5 if i == 5 else 0.0) and r["price_z"] == 0.0 and r["label"] == float(i == 5)
    assert got[2, 1]["dot_uv"] == 0.0 and got[2, 1]["max_sim_recent"] == 0.0
    assert math.isclose(got[3, 4]["max_sim_recent"], 1.0)


def feature_rows(spark, n=400):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 5))
    label = (np.arange(n) % 8 == 0).astype(float)
    x[:, 0] += 2 * label
    rows = [(int(i // 8), int(i % 8), int(i % 8), *map(float, x[i]), float(label[i])) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, item_idx long, slot long, dot_uv double, max_sim_recent double, pop double, hist_len double, price_z double, label double"), x, label


def test_negatives_keep_the_positive_first(spark):
    df, _, _ = feature_rows(spark)
    for picked in (K.hard_negatives(df, 3), K.random_negatives(df, 3)):
        rows = picked.collect()
        assert len(rows) == 50 * 4 and all((r["label"] == 1.0) == (r["rank"] == 1) for r in rows)


def test_mask_share(spark):
    df, _, _ = feature_rows(spark, 4000)
    masked = K.mask_features(df, ("dot_uv",), 0.3).where("dot_uv = 0").count()
    assert 0.25 < masked / 4000 < 0.35


def test_wide_dense_ranker_matches_numpy(spark):
    df, x, _ = feature_rows(spark)
    rng = np.random.default_rng(10)
    layer = lambda o, i: (rng.normal(size=(o, i)) / math.sqrt(i), rng.normal(size=o))
    norms = [(rng.normal(size=n), rng.normal(size=n)) for n in (384, 384, 192)]
    ranker = S.DenseRanker([layer(384, 5), layer(384, 384), layer(192, 384)], layer(1, 192), norms)

    def by_hand(row):
        for (w, b), (g, s) in zip(ranker.hidden, norms):
            y = w @ row + b
            y = np.maximum((y - y.mean()) / np.sqrt(y.var() + 1e-5) * g + s, 0)
            row = y + row if len(y) == len(row) else y
        return float(ranker.out[0][0] @ row + ranker.out[1][0])

    got = {(r["query_id"], r["item_idx"]): r["score"] for r in S.score_features(df, ranker).collect()}
    assert all(math.isclose(got[i // 8, i % 8], by_hand(x[i]), rel_tol=1e-6, abs_tol=1e-9) for i in range(0, 400, 17))


def test_trained_rankers_learn(spark):
    df, _, _ = feature_rows(spark)
    for kind in ("mlp", "logistic"):
        scored = S.score_with(S.fit_ranker(df, (4,), kind), df)
        assert E.recall_from_scores(scored, 1).first()["recall"] > 0.5
        assert scored.where("score < 0 OR score > 1").count() == 0


def test_rerank_one_query(spark):
    rows = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.9), (1, 12, 0.9)], "query_id long, item_idx long, score double")
    assert lists(K.rerank(rows, 2), "query_id") == {1: [11, 12]}


def test_unscored_query_keeps_its_order(spark):
    q = spark.createDataFrame([(1, [3, 1, 2])], "query_id long, cands array<long>")
    rows = spark.createDataFrame([(1, 3, None)], "query_id long, item_idx long, score double")
    got = K.rerank_or_keep(q, rows, 2).orderBy("rank").collect()
    assert [(r["item_idx"], r["score"]) for r in got] == [(3, 1.0), (1, 1.0)]


def test_mix_rankers(spark):
    q = spark.createDataFrame([(1, [1, 2, 3])], "query_id long, cands array<long>")
    table = lambda rows: spark.createDataFrame([(1, n + 1, i, s) for n, (i, s) in enumerate(rows)], "query_id long, rank long, item_idx long, score double")
    both = {"a": table([(1, 1.0), (2, 0.4)]), "b": table([(2, 0.8)])}
    got = {r["item_idx"]: r["score"] for r in K.mix_rankers(q, both, 3).collect()}
    assert got == {1: 0.5, 2: 0.3, 3: 0.0}
    assert {r["item_idx"]: r["score"] for r in K.mix_rankers(q, both, 3, method="max").collect()}[2] == 0.4


# ---- metrics ----------------------------------------------------------------------------------
def small_lists(spark):
    return spark.createDataFrame([("m", 1, [1, 2, 3], 2), ("m", 2, [4, 5, 6], 7)], "model string, query_id long, recs array<long>, truth long")


def test_metrics(spark):
    df = small_lists(spark)
    rows = E.from_lists(df)
    out = E.all_metrics(rows, df.select("query_id", "truth"), ["m"], [3], 10)
    got = {r["metric"]: r["value"] for r in out.collect()}
    assert got["Recall"] == 0.5 and math.isclose(got["NDCG"], 0.315464877, abs_tol=1e-9) and got["MRR"] == 0.25
    assert math.isclose(got["Coverage"], 0.6)
    assert E.id_diversity(rows, [3]).first()["value"] == 1.0


def test_metrics_without_queries_or_lists(spark):
    df = small_lists(spark)
    none = E.all_metrics(E.from_lists(df).limit(0), df.select("query_id", "truth"), ["m"], [3])
    assert {r["value"] for r in none.collect()} == {0.0}
    single = E.from_lists(df.select("model", "query_id", F.slice("recs", 1, 1).alias("recs")))
    assert E.id_diversity(single, [3]).first()["value"] == 0.0


def test_recall_grows_with_k(spark):
    df, _, _ = feature_rows(spark)
    scored = df.withColumn("score", F.col("dot_uv"))
    values = [E.recall_from_scores(scored, k).first()["recall"] for k in (1, 3, 5, 8)]
    assert values == sorted(values) and values[-1] == 1.0


def test_feature_diversity(spark):
    items, iv = random_vectors(spark, 30, "item_idx")
    df = spark.createDataFrame([("m", 1, [1, 2, 3]), ("m", 2, [4, 99, 5]), ("m", 3, [7]), ("m", 4, [8, 8, 9, 99])],
                               "model string, query_id long, recs array<long>")
    u = unit(iv)
    def spread(ids):
        s = u[ids] @ u[ids].T
        return 1 - (s.sum() - np.trace(s)) / (len(ids) * (len(ids) - 1))
    got = {r["k"]: r["value"] for r in E.feature_diversity(E.from_lists(df), items, [2, 3]).collect()}
    assert math.isclose(got[2], np.mean([spread([1, 2]), spread([8, 8])])) and math.isclose(got[3], np.mean([spread([1, 2, 3]), spread([8, 8, 9])]))


def test_running_means(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 4.0, 2), ("b", 5.0, 0)], "metric string, value double, count long")
    assert {r["metric"]: r["average"] for r in E.running_means(rows).collect()} == {"a": 3.0, "b": 0.0}


# ---- objectives -------------------------------------------------------------------------------
def test_objectives(spark):
    scores = [(1, 2.0, 1.0), (1, 1.0, 0.0), (1, 0.5, 0.0), (2, 60.0, 1.0), (2, 70.0, 0.0), (2, -5.0, 0.0)]
    df = spark.createDataFrame(scores, "query_id long, score double, label double")
    value = lambda out: out.first()["loss"]
    def nce(t, share):
        total = 0
        for q in (1, 2):
            logits = [(s / t, y) for k, s, y in scores if k == q]
            top = max(x for x, _ in logits)
            total += top + math.log(sum(math.exp(x - top) * (1 if y else share) for x, y in logits)) - next(x for x, y in logits if y)
        return total / 2
    assert math.isclose(value(O.info_nce(df)), nce(0.07, 1.0), rel_tol=1e-9)
    assert math.isclose(value(O.info_nce(df, 1.0, True)), nce(1.0, 0.5), rel_tol=1e-9)
    gaps = [1.0, 1.5, -10.0, 65.0]
    assert math.isclose(value(O.bpr(df)), np.mean([math.log1p(math.exp(-g)) for g in gaps]), rel_tol=1e-9)
    bce = np.mean([max(s, 0) - s * y + math.log1p(math.exp(-abs(s))) for _, s, y in scores])
    assert math.isclose(value(O.bce_with_logits(df)), bce) and math.isclose(value(O.mse(df)), np.mean([(s - y) ** 2 for _, s, y in scores]))
    with pytest.raises(ValueError):
        O.info_nce(df, 0.0)


def test_distance_objectives(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (1, 0.2, 0.0), (1, 3.0, 0.0)], "query_id long, distance double, label double")
    assert math.isclose(O.contrastive(df).first()["loss"], 0.25 + 0.64)
    assert math.isclose(O.triplet(df).first()["loss"], 1.3 / 2)
    rows = {r["name"]: r["loss"] for r in O.weighted_sum({"c": O.contrastive(df), "t": O.triplet(df)}, {"c": 1.0, "t": 2.0}).collect()}
    assert math.isclose(rows["total"], 0.89 + 1.3)
