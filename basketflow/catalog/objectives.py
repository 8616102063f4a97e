"""Queries for the training objectives, over each sample's target and five drawn negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketflow.catalog import query, views as V
from basketflow.catalog.sequencing import _catalog_size, _draws
from basketflow.catalog.sql import part, sql
from basketflow.operators import objectives as O
from basketflow.operators.negatives import with_negatives
from basketflow.operators.retrieval import history_vectors, unit_vectors

part("drawn", "seq prime", _draws(42, 5))
part("pairs", "drawn seq hv vec", """
SELECT p.query_id, p.item_idx, p.label, list_dot_product(hv.v, vec.u) AS score,
       sqrt(list_sum([(hv.v[i] - vec.u[i] + 1e-6) ** 2 FOR i IN range(1, 65)])) AS distance
FROM (SELECT query_id, pos_item_idx AS item_idx, 1.0::DOUBLE AS label FROM seq
      UNION ALL SELECT query_id, unnest(neg), 0.0::DOUBLE FROM drawn) p
JOIN hv USING (query_id) JOIN vec ON vec.item_idx = p.item_idx""")
part("apart", "pairs", """
SELECT n.query_id, p.score AS pos, n.score AS neg, p.distance AS dp, n.distance AS dn
FROM (SELECT * FROM pairs WHERE label = 0) n JOIN (SELECT * FROM pairs WHERE label = 1) p USING (query_id)""")


def pairs(spark, d):
    rows = with_negatives(V.sequences(spark, d), _catalog_size(spark, d), 5)
    label = lambda x, i: F.struct(x.alias("item_idx"), F.when(i == 0, 1.0).otherwise(0.0).alias("label"))
    both = F.transform(F.concat(F.array("pos_item_idx"), F.col("neg")), label)
    items = unit_vectors(V.vectors(spark, d)).withColumnRenamed("vector", "item_vector")
    users = history_vectors(rows, V.vectors(spark, d)).withColumnRenamed("vector", "user_vector")
    return rows.select("query_id", F.inline(both)).join(items, "item_idx").join(users, "query_id")


def _loss(rows):
    return rows.select(*V.six("loss"))


def softmax(scale: str, share: str = "1") -> str:
    return f"""
SELECT round(avg(ln(total) - target), 6) AS loss FROM (
  SELECT query_id, sum(exp(score * {scale}) * CASE WHEN label = 1 THEN 1 ELSE {share} END) AS total,
         max(CASE WHEN label = 1 THEN score * {scale} END) AS target FROM pairs GROUP BY 1)"""


@query("l1_info_nce", sql("pairs", softmax("(1 / 0.07::DOUBLE)")))
def l1(spark, d):
    return _loss(O.info_nce(O.pair_scores(pairs(spark, d))))


@query("l1_info_nce_corrected", sql("pairs", softmax("(1 / 0.07::DOUBLE)", "1 / 5.0::DOUBLE")))
def l1_corrected(spark, d):
    return _loss(O.info_nce(O.pair_scores(pairs(spark, d)), correct_sampling=True))


@query("l2_bpr", sql("apart", "SELECT round(avg(ln(1 + exp(neg - pos))), 6) AS loss FROM apart"))
def l2(spark, d):
    return _loss(O.bpr(O.pair_scores(pairs(spark, d))))


CONTRASTIVE = """SELECT avg(loss) AS loss FROM (SELECT query_id,
  sum(CASE WHEN label = 1 THEN distance ** 2 ELSE greatest(1 - distance, 0) ** 2 END) AS loss FROM pairs GROUP BY 1)"""
TRIPLET = "SELECT avg(loss) AS loss FROM (SELECT query_id, avg(greatest(dp - dn + 1, 0)) AS loss FROM apart GROUP BY 1)"


@query("l3_contrastive", sql("pairs", f"SELECT round(loss, 6) AS loss FROM ({CONTRASTIVE})"))
def l3(spark, d):
    return _loss(O.contrastive(O.pair_distances(pairs(spark, d))))


@query("l4_triplet", sql("apart", f"SELECT round(loss, 6) AS loss FROM ({TRIPLET})"))
def l4(spark, d):
    return _loss(O.triplet(O.pair_distances(pairs(spark, d))))


@query("l5_sampled_softmax", sql("pairs", softmax("1")))
def l5(spark, d):
    return _loss(O.sampled_softmax(pairs(spark, d)))


part("losses", "pairs apart", f"""
SELECT 'contrastive' AS name, loss, 0.25::DOUBLE AS weight FROM ({CONTRASTIVE})
UNION ALL SELECT 'triplet', loss, 0.75 FROM ({TRIPLET})""")


@query("l6_weighted_sum", sql("losses", """
SELECT name, round(loss, 6) AS loss, weight FROM losses
UNION ALL SELECT 'total', round(sum(loss * weight), 6), 1.0 FROM losses"""))
def l6(spark, d):
    rows = O.pair_distances(pairs(spark, d))
    total = O.weighted_sum({"contrastive": O.contrastive(rows), "triplet": O.triplet(rows)}, {"contrastive": 0.25, "triplet": 0.75})
    return total.select("name", *V.six("loss"), "weight")


@query("l7_bce_and_mse", sql("pairs", """
SELECT 'bce' AS name, round(avg(greatest(score, 0) - score * label + ln(1 + exp(-abs(score)))), 6) AS loss FROM pairs
UNION ALL SELECT 'mse', round(avg((score - label) ** 2), 6) FROM pairs"""))
def l7(spark, d):
    rows = O.pair_scores(pairs(spark, d)).select("score", "label")
    both = O.bce_with_logits(rows).select(F.lit("bce").alias("name"), "loss")
    return both.unionByName(O.mse(rows).select(F.lit("mse").alias("name"), "loss")).select("name", *V.six("loss"))
