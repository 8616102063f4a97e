"""Queries behind a customer's page."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import query, views as V
from basketflow.catalog.ranking import _dense_first
from basketflow.catalog.sql import features as define_features, history_vectors as define_vectors, part, sql, top
from basketflow.operators import serving as S, tables as T
from basketflow.operators.baselines import most_popular
from basketflow.operators.retrieval import CellIndex
from basketflow.operators.scoring import best_scored
from basketflow.session import settle

LABEL = "upper({0}[1:1]) || lower({0}[2:])"
part("recent_all", "clean", """
SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date DESC, stock_code) AS recency FROM clean""")
part("recent", "recent_all", "SELECT * FROM recent_all WHERE recency <= 50")
part("shown", "clean", """
SELECT customer_id, count(*) AS total, least(greatest(3, floor(count(*) * 0.75)), 9, count(*))::BIGINT AS shown FROM clean GROUP BY 1""")


@query("w7_recent_purchases", sql("recent", "SELECT customer_id, recency, stock_code, invoice_date FROM recent"))
def w7(spark, d):
    return S.recent_purchases(V.clean(spark, d)).select("customer_id", "recency", "stock_code", "invoice_date")


@query("w7_all_purchases", sql("recent_all", "SELECT customer_id, recency, stock_code FROM recent_all"))
def w7_all(spark, d):
    return S.recent_purchases(V.clean(spark, d), None).select("customer_id", "recency", "stock_code")


@query("w8_display_counts", sql("shown", "SELECT * FROM shown"))
def w8(spark, d):
    return S.display_counts(V.clean(spark, d))


@query("w8_displayed_purchases", sql("recent_all shown", f"""
SELECT customer_id, recency, stock_code, description AS title, round(price, 9) AS price, {LABEL.format('category')} AS category
FROM recent_all JOIN shown USING (customer_id) WHERE recency <= shown"""))
def w8_displayed(spark, d):
    rows = S.displayed_purchases(V.clean(spark, d))
    return rows.select("customer_id", "recency", "stock_code", "title", *V.nine("price"), "category")


part("cats", "recent", """
SELECT customer_id, category, count(*) AS purchases,
       row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, category) AS rank FROM recent GROUP BY 1, 2""")
part("brands", "recent", """
SELECT customer_id, brand, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, brand) AS rank FROM recent GROUP BY 1, 2""")


@query("a8_top_categories", sql("cats", f"SELECT customer_id, rank, {LABEL.format('category')} AS category, purchases FROM cats WHERE rank <= 5"))
def a8_categories(spark, d):
    return S.top_categories(V.clean(spark, d))


def _profile(n: int) -> str:
    return sql("recent cats brands", f"""
SELECT customer_id, n_lines, mean_price, brand AS favorite_brand, tops AS top_categories
FROM (SELECT customer_id, count(*) AS n_lines, round(avg(price), 6) AS mean_price FROM recent GROUP BY 1)
JOIN (SELECT customer_id, brand FROM brands WHERE rank = 1) USING (customer_id)
JOIN (SELECT customer_id, string_agg({LABEL.format('category')} || ':' || purchases, ', ' ORDER BY rank) AS tops
      FROM cats WHERE rank <= {n} GROUP BY 1) USING (customer_id)""")


def _listed(rows):
    entry = F.transform("top_categories", lambda t: F.concat(t["category"], F.lit(":"), t["purchases"].cast("string")))
    return rows.select("customer_id", "n_lines", *V.six("mean_price"), "favorite_brand", F.array_join(entry, ", ").alias("top_categories"))


@query("a8_customer_profiles", _profile(5))
def a8(spark, d):
    return _listed(S.customer_profile(V.clean(spark, d)))


@query("r21_explanations", _profile(3))
def r21(spark, d):
    return _listed(S.explanations(V.clean(spark, d)))


part("popular_items", "items item_map", """
SELECT item_idx, popularity FROM items JOIN item_map USING (stock_code) ORDER BY popularity DESC, item_idx LIMIT 10""")


@query("k4_most_popular", sql("popular_items", "SELECT * FROM popular_items"))
def k4(spark, d):
    rows = V.clean(spark, d)
    items = T.item_catalog(rows).join(T.item_id_map(rows), "stock_code").select("item_idx", "popularity")
    return most_popular(items, 10)


part("served_history", "recent item_map vec", """
SELECT customer_id AS query_id, list(item_idx ORDER BY place DESC) AS history, -1 AS pos_item_idx FROM (
  SELECT customer_id, item_idx, row_number() OVER (PARTITION BY customer_id ORDER BY recency) AS place
  FROM recent JOIN item_map USING (stock_code)) SEMI JOIN vec USING (item_idx) WHERE place <= 15 GROUP BY 1""")
define_vectors("sv", "served_history")
part("served_scores", "sv vec", "SELECT query_id, item_idx, round(list_dot_product(sv.v, vec.u), 9) AS score FROM sv, vec")
part("served_top", "served_scores", top("served_scores", 200))
part("served_cands", "served_top served_history", """
SELECT query_id, history, pos_item_idx, cands FROM served_history
JOIN (SELECT query_id, list(item_idx ORDER BY rank) AS cands FROM served_top GROUP BY 1) USING (query_id)""")
define_features("sfeat", "served_cands", "sv", None, None)
part("sfeat_scores", "sfeat", f"SELECT query_id, item_idx, round(score, 9) AS score FROM ({_dense_first('sfeat')})")
part("served", "sfeat_scores clean popular_items", f"""
SELECT query_id AS customer_id, rank, item_idx, score, 'ranker' AS source FROM ({top('sfeat_scores', 10)})
UNION ALL
SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY popularity DESC, item_idx), item_idx, 1.0, 'popular'
FROM (SELECT DISTINCT customer_id FROM clean WHERE customer_id NOT IN (SELECT query_id FROM sfeat_scores)) CROSS JOIN popular_items""")


def _served(spark, d, attributes=(), **search):
    """Recommendations, the catalog with the attributes that are shown of it, and its numbers."""
    rows = V.clean(spark, d)
    # Settled: the popular list and the cards read the catalog, which is made once.
    items, item_map, vectors = settle(T.item_catalog(rows, attributes)), T.item_id_map(rows), V.vectors(spark, d)
    scorer = lambda features: best_scored(features, {"score": V.dense_ranker()}, 10)
    ranked = S.recommend_customers(rows, items, item_map, vectors, scorer, 10, **search)
    popular = S.popular_fallback(rows.select("customer_id").distinct(), ranked, items, item_map, 10)
    return ranked.unionByName(popular), items, item_map


@query("r19_customer_recommendations", sql("served", "SELECT customer_id, rank, item_idx, score, source FROM served"))
def r19(spark, d):
    return _served(spark, d)[0]


@query("r19_recommendations_by_cells", sql("served", "SELECT customer_id, rank, item_idx, score, source FROM served"))
def r19_cells(spark, d):
    return _served(spark, d, index=CellIndex.build(V.vectors(spark, d), 8), probes=8)[0]


@query("r20_popular_fallback", sql("served", "SELECT customer_id, rank, item_idx FROM served WHERE source = 'popular'"))
def r20(spark, d):
    return _served(spark, d)[0].where(F.col("source") == "popular").select("customer_id", "rank", "item_idx")


@query("j9_recommended_cards", sql("served items item_map", f"""
SELECT customer_id, rank, item_idx, stock_code, description AS title, round(price_median, 9) AS price, {LABEL.format('category')} AS category
FROM served JOIN item_map USING (item_idx) JOIN items USING (stock_code)"""))
def j9(spark, d):
    recs, items, item_map = _served(spark, d, ("description", "category"))
    rows = S.with_catalog(recs, items, item_map)
    return rows.select("customer_id", "rank", "item_idx", "stock_code", "title", *V.nine("price"), "category")
