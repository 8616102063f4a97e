"""Queries for single metrics; the lists are the histories themselves, which repeat items."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import query, views as V
from basketflow.catalog.sql import part, sql
from basketflow.operators import evaluate as E
from basketflow.sources.retail import table

part("hist_lists", "seq", "SELECT 'History' AS model, query_id, unnest(history) AS item_idx, unnest(range(1, len(history) + 1)) AS rank FROM seq")
part("hist_hits", "seq", """
SELECT query_id, k, nullif(list_position(history[:k], pos_item_idx), 0) AS hit FROM seq, (SELECT unnest([5, 10, 15])::BIGINT AS k)""")
KS = (5, 10, 15)


def _lists(spark, d):
    rows = V.sequences(spark, d)
    return E.from_lists(rows.select(F.lit("History").alias("model"), "query_id", F.col("history").alias("recs"))), rows


def _ranking(spark, d, metric: str):
    lists, rows = _lists(spark, d)
    ranks = E.truth_ranks(lists, rows.select("query_id", F.col("pos_item_idx").alias("truth")), ["History"])
    return E.ranking_metrics(ranks, KS).where(F.col("metric") == metric).select("k", *V.six("value"))


def _hit_sql(gain: str) -> str:
    return sql("hist_hits", f"SELECT k, round(avg(CASE WHEN hit IS NOT NULL THEN {gain} ELSE 0.0 END), 6) AS value FROM hist_hits GROUP BY k")


@query("v1_recall", _hit_sql("1.0"))
def v1(spark, d):
    return _ranking(spark, d, "Recall")


@query("v2_ndcg", _hit_sql("1.0 / log2(hit + 1)"))
def v2(spark, d):
    return _ranking(spark, d, "NDCG")


@query("v3_mrr", _hit_sql("1.0 / hit"))
def v3(spark, d):
    return _ranking(spark, d, "MRR")


ZEROS = """
SELECT metric, k, 0.0::DOUBLE AS value FROM (SELECT unnest(['Recall', 'NDCG', 'MRR', 'Coverage', 'Diversity']) AS metric),
     (SELECT unnest([5, 10, 15])::BIGINT AS k)"""


@query("v8_without_queries", f"SELECT 'History' AS model, * FROM ({ZEROS})")
def v8_none(spark, d):
    lists, rows = _lists(spark, d)
    truths = rows.select("query_id", F.col("pos_item_idx").alias("truth")).where(F.lit(False))
    return E.all_metrics(lists.where(F.lit(False)), truths, ["History"], KS, V.n_items(spark, d), V.vectors(spark, d))


@query("v8_model_without_lists", f"SELECT 'Silent' AS model, * FROM ({ZEROS})")
def v8_silent(spark, d):
    lists, rows = _lists(spark, d)
    truths = rows.select("query_id", F.col("pos_item_idx").alias("truth"))
    both = E.all_metrics(lists, truths, ["History", "Silent"], KS, V.n_items(spark, d), V.vectors(spark, d))
    return both.where(F.col("model") == "Silent")


@query("v4_coverage", sql("hist_lists all_items", """
SELECT k, round(count(DISTINCT item_idx) / (SELECT count(*) FROM all_items)::DOUBLE, 6) AS value
FROM hist_lists, (SELECT unnest([1, 2, 5])::BIGINT AS k) WHERE rank <= k GROUP BY k"""))
def v4(spark, d):
    lists, _ = _lists(spark, d)
    return E.coverage_metrics(lists, V.n_items(spark, d), (1, 2, 5)).select("k", *V.six("value"))


ID_DIVERSITY = """
SELECT 'ids' AS kind, k, round(avg(distinct_n / n::DOUBLE), 6) AS value FROM (
  SELECT query_id, k, count(*) AS n, count(DISTINCT item_idx) AS distinct_n
  FROM hist_lists, (SELECT unnest([5, 10, 15])::BIGINT AS k) WHERE rank <= k GROUP BY 1, 2) WHERE n > 1 GROUP BY k"""
FEATURE_DIVERSITY = """
SELECT 'features' AS kind, k, round(avg(1 - (list_dot_product(s, s) - own) / (n * (n - 1))), 6) AS value FROM (
  SELECT query_id, k, any_value(n) AS n, list(x ORDER BY d) AS s, any_value(own) AS own FROM (
    SELECT query_id, k, d, sum(x) AS x, max(n) AS n, max(own) AS own FROM (
      SELECT l.query_id, ks.k, unnest(v.u) AS x, unnest(range(len(v.u))) AS d,
             count(*) OVER (PARTITION BY l.query_id, ks.k) AS n,
             sum(list_dot_product(v.u, v.u)) OVER (PARTITION BY l.query_id, ks.k) AS own
      FROM hist_lists l CROSS JOIN (SELECT unnest([5, 10, 15])::BIGINT AS k) ks JOIN vec v USING (item_idx) WHERE l.rank <= ks.k)
    GROUP BY 1, 2, 3) GROUP BY 1, 2) WHERE n > 1 GROUP BY k"""


@query("v5_id_diversity", sql("hist_lists", ID_DIVERSITY))
def v5(spark, d):
    lists, _ = _lists(spark, d)
    return E.diversity(lists, KS).select(F.lit("ids").alias("kind"), "k", *V.six("value"))


@query("v6_feature_diversity", sql("hist_lists vec", FEATURE_DIVERSITY))
def v6(spark, d):
    lists, _ = _lists(spark, d)
    return E.diversity(lists, KS, V.vectors(spark, d)).select(F.lit("features").alias("kind"), "k", *V.six("value"))


@query("v7_both_diversities", sql("hist_lists vec", f"{ID_DIVERSITY} UNION ALL {FEATURE_DIVERSITY}"))
def v7(spark, d):
    return v5(spark, d).unionByName(v6(spark, d))


@query("v8_all_metrics", sql("hist_lists hist_hits vec all_items", f"""
SELECT 'Recall' AS metric, k, round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS value FROM hist_hits GROUP BY k
UNION ALL SELECT 'NDCG', k, round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 / log2(hit + 1) ELSE 0.0 END), 6) FROM hist_hits GROUP BY k
UNION ALL SELECT 'MRR', k, round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 / hit ELSE 0.0 END), 6) FROM hist_hits GROUP BY k
UNION ALL SELECT 'Coverage', k, round(count(DISTINCT item_idx) / (SELECT count(*) FROM all_items)::DOUBLE, 6)
FROM hist_lists, (SELECT unnest([5, 10, 15])::BIGINT AS k) WHERE rank <= k GROUP BY k
UNION ALL SELECT 'Diversity', k, value FROM ({FEATURE_DIVERSITY})"""))
def v8(spark, d):
    lists, rows = _lists(spark, d)
    truths = rows.select("query_id", F.col("pos_item_idx").alias("truth"))
    out = E.all_metrics(lists, truths, ["History"], KS, V.n_items(spark, d), V.vectors(spark, d))
    return out.select("metric", "k", *V.six("value"))


@query("a12_running_means", """
SELECT event_type AS metric, round(sum(value * CAST(json_extract_string(props, '$.k') AS BIGINT)) /
       sum(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS average FROM events GROUP BY 1""")
def a12(spark, d):
    weight = F.get_json_object("props", "$.k").cast("long")
    records = table(spark, d, "events").select(F.col("event_type").alias("metric"), "value", weight.alias("count"))
    return E.running_means(records).select("metric", *V.six("average"))
