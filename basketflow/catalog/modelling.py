"""Queries over the user × item table: matrices, similarities, baseline recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.catalog import query, views as V
from basketflow.catalog.sql import FACTOR_RANK, FACTOR_ROUNDS, FACTOR_STEPS, item_knn, metrics, part, sql, top
from basketflow.operators import baselines as B, matrix as M
from basketflow.operators.evaluate import all_metrics, best_model, distinct_items, improvement
from basketflow.operators.factorize import factorize, loss_table
from basketflow.plans.evaluation import BASELINES, baseline_lists, truths
from basketflow.session import settle
from basketflow.sources.retail import event_lines

# Few rounds, so that SQL can follow; none of them is the last by a small gain.
FACTORS = {"rank": FACTOR_RANK, "rounds": FACTOR_ROUNDS, "tolerance": 0.0}


@query("m1_matrix", sql("mat", "SELECT * FROM mat"))
def m1(spark, d):
    return V.matrix(spark, d)


@query("m2_count_matrix", sql("knn", "SELECT * FROM knn"))
def m2(spark, d):
    return V.knn_matrix(spark, d)


@query("m3_without_held_out", sql("mat seq", """
SELECT user_idx, item_idx, weight FROM mat
WHERE NOT EXISTS (SELECT 1 FROM seq s WHERE s.split = 'val' AND s.user_idx = mat.user_idx AND s.pos_item_idx = mat.item_idx)"""))
def m3(spark, d):
    held = V.split(spark, d, "val").select("user_idx", F.col("pos_item_idx").alias("item_idx"))
    return M.without_cells(V.matrix(spark, d), held)


@query("a6_popularity", sql("pop", "SELECT item_idx, pop, round(pop / max(pop) OVER (), 6) AS scaled FROM pop"))
def a6(spark, d):
    rows = V.matrix(spark, d)
    scaled = B.scaled_popularity(rows).select("item_idx", F.round("pop", 6).alias("scaled"))
    return B.popularity(rows).join(scaled, "item_idx")


@query("a11_matrix_statistics", sql("mat ev", """
SELECT u AS n_users, i AS n_items, n AS nonzeros, round(n / (u * i)::DOUBLE, 6) AS density
FROM (SELECT count(DISTINCT user_idx) AS u, count(DISTINCT item_idx) AS i FROM ev), (SELECT count(*) AS n FROM mat WHERE weight <> 0)"""))
def a11(spark, d):
    sizes = event_lines(spark, d).agg(F.countDistinct("user_idx").alias("u"), F.countDistinct("item_idx").alias("i")).first()
    return M.matrix_statistics(V.matrix(spark, d), sizes["u"], sizes["i"]).withColumn("density", F.round("density", 6))


@query("j3_unseen_scores", sql("pop_scores", "SELECT user_idx, item_idx, score FROM pop_scores QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) <= 5"))
def j3(spark, d):
    return B.recommend_popular(V.matrix(spark, d), V.users(spark, d), 5).drop("rank")


part("held_scores", "tests pop mat", """
SELECT t.query_id, p.item_idx, p.pop AS score FROM tests t, pop p
WHERE p.item_idx = t.pos_item_idx OR NOT EXISTS (SELECT 1 FROM mat m WHERE m.user_idx = t.user_idx AND m.item_idx = p.item_idx AND m.weight <> 0)""")


@query("j4_unseen_or_held_out", sql("held_scores", top("held_scores", 10)))
def j4(spark, d):
    queries = V.tests(spark, d).select("query_id", "user_idx", F.col("pos_item_idx").alias("truth"))
    return B.recommend_popular(V.matrix(spark, d), queries, 10, key="query_id")


@query("m4_popular_lists", sql("pop_recs", "SELECT * FROM pop_recs"))
def m4(spark, d):
    return B.recommend_popular(V.matrix(spark, d), V.users(spark, d), 20)


part("pop_lists", "pop_recs tests", "SELECT 'Popularity' AS model, query_id, rank, item_idx FROM tests JOIN pop_recs USING (user_idx)")


@query("m4_popularity_metrics", sql("pop_lists truths all_items", metrics("pop_lists", "truths", V.KS)))
def m4_metrics(spark, d):
    v = V.Shared(spark, d)
    lists = settle(B.for_queries(B.recommend_popular(v.matrix, v.users, 20), v.tests, "Popularity"))
    out = all_metrics(lists, truths(v.tests), ["Popularity"], V.KS, v.n_items)
    return out.withColumn("value", F.round("value", 6))


@query("m5_item_similarity", sql("ksim", "SELECT a, b, round(similarity, 6) AS similarity FROM ksim WHERE a < b"))
def m5(spark, d):
    return M.item_similarity(V.knn_matrix(spark, d)).select("a", "b", *V.six("similarity"))


@query("m5_item_similarity_blocks", sql("isim", "SELECT a, b, round(similarity, 6) AS similarity FROM isim WHERE a < b"))
def m5_blocks(spark, d):
    return M.item_similarity(V.matrix(spark, d), wide=30, block=16).select("a", "b", *V.six("similarity"))


@query("m6_item_knn", sql("iknn_recs", "SELECT user_idx, rank, item_idx, score FROM iknn_recs"))
def m6(spark, d):
    v = V.Shared(spark, d)
    return B.recommend_item_knn(M.user_profile(v.knn_matrix, v.users), M.item_similarity(v.knn_matrix), v.knn_matrix, 20, users=v.users)


@query("m6_item_knn_blocks", sql("iknn_recs", "SELECT user_idx, rank, item_idx, score FROM iknn_recs"))
def m6_blocks(spark, d):
    """The same lists from many small blocks, as a large catalog has them."""
    v = V.Shared(spark, d)
    profile = M.user_profile(v.knn_matrix, v.users)
    return B.recommend_item_knn(profile, M.item_similarity(v.knn_matrix), v.knn_matrix, 20, users=v.users, left_rows=40, right_entries=1500)


part("strangers", "iknn_pop", "SELECT -1::BIGINT AS user_idx, item_idx, round(0.01 * pop, 9) AS score FROM iknn_pop")


@query("m6_users_without_profile", sql("iknn_recs strangers", f"""
SELECT user_idx, rank, item_idx, score FROM iknn_recs UNION ALL SELECT user_idx, rank, item_idx, score FROM ({top('strangers', 20, 'user_idx')})"""))
def m6_strangers(spark, d):
    v = V.Shared(spark, d)
    everyone = v.users.union(v.users.limit(1).select(F.lit(-1).cast("long")))
    return B.recommend_item_knn(M.user_profile(v.knn_matrix, v.users), M.item_similarity(v.knn_matrix), v.knn_matrix, 20, users=everyone)


@query("m7_user_similarity", sql("usim", "SELECT a, b, round(similarity, 6) AS similarity FROM usim WHERE a < b"))
def m7(spark, d):
    return M.user_similarity(V.matrix(spark, d)).select("a", "b", *V.six("similarity"))


@query("m8_nearest_users", sql("uknn_near", "SELECT user_idx, neighbor, round(similarity, 9) AS similarity, rank FROM uknn_near"))
def m8_near(spark, d):
    v = V.Shared(spark, d)
    return B.nearest_users(v.matrix, v.users).withColumn("similarity", F.round("similarity", 9))


@query("m8_nearest_users_blocks", sql("uknn_near", "SELECT user_idx, neighbor, round(similarity, 9) AS similarity, rank FROM uknn_near"))
def m8_near_blocks(spark, d):
    """The same neighbors from many small blocks, as many users have them."""
    v = V.Shared(spark, d)
    near = B.nearest_users(v.matrix, v.users, left_rows=40, right_entries=1000)
    return near.withColumn("similarity", F.round("similarity", 9))


@query("m8_user_knn", sql("uknn_recs", "SELECT user_idx, rank, item_idx, score FROM uknn_recs"))
def m8(spark, d):
    v = V.Shared(spark, d)
    return B.recommend_user_knn(v.matrix, v.users, 20)


def _factors(spark, d, rows):
    return factorize(rows, **FACTORS, steps=FACTOR_STEPS)


@query("m9_factor_loss", sql("mf_losses", "SELECT round, round(loss, 4) AS loss FROM mf_losses"))
def m9_loss(spark, d):
    """The squared error over all cells before the first round and after each."""
    return loss_table(_factors(spark, d, V.matrix(spark, d)), spark).withColumn("loss", F.round("loss", 4))


@query("m9_factor_vectors", sql("mf_users mf_items", """
SELECT 'user' AS side, user_idx AS id, round(sum(x), 6) AS total, round(sum(x * (k + 1)), 6) AS weighted FROM mf_users GROUP BY 2
UNION ALL SELECT 'item', item_idx, round(sum(x), 6), round(sum(x * (k + 1)), 6) FROM mf_items GROUP BY 2"""))
def m9_vectors(spark, d):
    """Every user's and item's factors, as two sums that name their values and places."""
    model = _factors(spark, d, V.matrix(spark, d))
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x)
    placed = F.aggregate(F.transform("vector", lambda x, k: x * (k + 1)), F.lit(0.0), lambda t, x: t + x)
    shown = lambda rows, side, ident: rows.select(
        F.lit(side).alias("side"), F.col(ident).alias("id"), F.round(total, 6).alias("total"), F.round(placed, 6).alias("weighted"))
    return shown(model.users, "user", "user_idx").unionByName(shown(model.items, "item", "item_idx"))


@query("m9_factor_recommendations", sql("mf_recs", "SELECT user_idx, rank, item_idx, round(score, 6) AS score FROM mf_recs"))
def m9_recs(spark, d):
    v = V.Shared(spark, d)
    return B.factor_lists(_factors(spark, d, v.matrix), v.matrix, v.users, 20).withColumn("score", F.round("score", 6))


@query("m9_factor_lists", sql("users mat", """
SELECT u.user_idx, least(10, (SELECT count(DISTINCT item_idx) FROM mat) - count(m.item_idx)) AS listed,
       0::BIGINT AS seen, true AS dense, true AS falling
FROM (SELECT user_idx FROM users SEMI JOIN mat USING (user_idx)) u
LEFT JOIN mat m ON m.user_idx = u.user_idx AND m.weight <> 0 GROUP BY 1"""))
def m9(spark, d):
    """What holds of every trained list, here of the operator's own number of rounds: k or all unseen items, none seen, dense ranks, falling scores."""
    v = V.Shared(spark, d)
    lists = settle(B.recommend_factors(v.matrix, v.users, 10))
    seen = v.matrix.where("weight <> 0").select("user_idx", "item_idx", F.lit(1).alias("was_seen"))
    marked = lists.join(seen, ["user_idx", "item_idx"], "left")
    later = F.lead("score").over(W.partitionBy("user_idx").orderBy("rank"))
    marked = marked.withColumn("falls", F.coalesce(later <= F.col("score"), F.lit(True)))
    return marked.groupBy("user_idx").agg(
        F.count(F.lit(1)).alias("listed"), F.count("was_seen").alias("seen"),
        (F.max("rank") == F.countDistinct("rank")).alias("dense"), F.bool_and("falls").alias("falling"))


def _baseline_metrics(spark, d):
    v = V.Shared(spark, d)
    lists = baseline_lists(v.matrix, v.tests, max(V.KS), v.knn_matrix, **FACTORS)
    return all_metrics(lists, truths(v.tests), BASELINES, V.KS, v.n_items)


BASELINE_METRICS = metrics("lists", "truths", V.KS)


@query("m10_baseline_metrics", sql("lists truths all_items", BASELINE_METRICS))
def m10(spark, d):
    return _baseline_metrics(spark, d).withColumn("value", F.round("value", 6))


@query("m12_best_baseline", sql("lists truths all_items", f"""
SELECT arg_min(model, (-value, model)) AS best_model, round(max(value), 6) AS best_value, 20::BIGINT AS k
FROM ({BASELINE_METRICS}) WHERE metric = 'Recall' AND k = 20"""))
def m12(spark, d):
    rows = _baseline_metrics(spark, d).withColumn("value", F.round("value", 6))
    return best_model(rows)


@query("m12_improvement", sql("lists truths all_items", f"""
SELECT a.metric, a.k, a.value, b.value AS baseline, round(a.value - b.value, 6) AS delta,
       round(CASE WHEN b.value > 0 THEN (a.value - b.value) / b.value * 100 ELSE 0 END, 6) AS improvement_pct
FROM ({BASELINE_METRICS}) a JOIN ({BASELINE_METRICS}) b USING (metric, k) WHERE a.model = 'ItemKNN' AND b.model = 'Popularity'"""))
def m12_improvement(spark, d):
    rows = _baseline_metrics(spark, d).withColumn("value", F.round("value", 6))
    return improvement(rows, "ItemKNN", "Popularity").select("metric", "k", "value", "baseline", *V.six("delta", "improvement_pct"))


item_knn("sknn", "mat", "knn", "ksim", 0.0)
part("sknn_some", "sknn_scores", "SELECT * FROM sknn_scores WHERE raw_score > 0")


@query("m13_item_knn_summary", sql("sknn_some", f"SELECT user_idx, rank, item_idx, score FROM ({top('sknn_some', 10, 'user_idx')})"))
def m13(spark, d):
    v = V.Shared(spark, d)
    return B.recommend_item_knn(M.user_profile(v.matrix, v.users), M.item_similarity(v.knn_matrix), v.knn_matrix, 10, alpha=0.0)


@query("k2_top_items_per_user", sql("mat", f"SELECT user_idx, rank, item_idx, score FROM ({top('(SELECT user_idx, item_idx, weight AS score FROM mat)', 5, 'user_idx')})"))
def k2(spark, d):
    from basketflow.operators.retrieval import top_items

    return top_items(V.matrix(spark, d).withColumnRenamed("weight", "score"), 5, "user_idx")


@query("u4_recommended_items", sql("pop_recs", "SELECT count(DISTINCT item_idx) AS n FROM pop_recs"))
def u4(spark, d):
    v = V.Shared(spark, d)
    return distinct_items(B.recommend_popular(v.matrix, v.users, 20))
