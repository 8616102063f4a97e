"""Training objectives as aggregates over scored or measured (query, item) rows.

``label`` is 1 on a query's positive row and 0 on its negatives.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions.vectors import distance, dot

# Fixed value: added to each coordinate difference before a distance.
DISTANCE_SHIFT = 1e-6

_IS_POSITIVE = "label > 0.5"


def pair_scores(pairs: DataFrame) -> DataFrame:
    """``(query_id, score, label)`` from rows with user_vector and item_vector."""
    return pairs.withColumn("score", dot(F.col("user_vector"), F.col("item_vector")))


def pair_distances(pairs: DataFrame, shift: float = DISTANCE_SHIFT) -> DataFrame:
    return pairs.withColumn("distance", distance(F.col("user_vector"), F.col("item_vector"), shift))


def _softplus(x: Column) -> Column:
    """ln(1 + eˣ) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def info_nce(scored: DataFrame, temperature: float = 0.07, correct_sampling: bool = False) -> DataFrame:
    """Mean over queries of logsumexp(all) − positive, on scores / temperature.

    With ``correct_sampling`` ln(number of negatives) comes off each negative.
    """
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    logit = F.col("score") / max(temperature, 1e-6)
    rows = scored.select("query_id", logit.alias("logit"), F.expr(_IS_POSITIVE).alias("positive"))
    tops = rows.groupBy("query_id").agg(
        F.max("logit").alias("top"), F.max(F.when(F.col("positive"), F.col("logit"))).alias("target"),
        F.sum((~F.col("positive")).cast("double")).alias("n_neg"),
    )
    share = F.when(F.col("positive") | F.lit(not correct_sampling), 1.0).otherwise(F.lit(1.0) / F.col("n_neg"))
    sums = rows.join(tops, "query_id").groupBy("query_id").agg(
        F.first("top").alias("top"), F.first("target").alias("target"),
        F.sum(share * F.exp(F.col("logit") - F.col("top"))).alias("total"),
    )
    return sums.agg(F.avg(F.col("top") + F.log("total") - F.col("target")).alias("loss"))


def sampled_softmax(pairs: DataFrame, temperature: float = 1.0) -> DataFrame:
    """InfoNCE without correction over gathered vectors."""
    return info_nce(pair_scores(pairs), temperature, False)


def _against_positive(rows: DataFrame, value: str) -> DataFrame:
    """Each negative row with its query's positive value: ``(query_id, pos, neg)``."""
    positive = rows.where(_IS_POSITIVE).select("query_id", F.col(value).alias("pos"))
    negative = rows.where(f"NOT ({_IS_POSITIVE})").select("query_id", F.col(value).alias("neg"))
    return negative.join(positive, "query_id")


def bpr(scored: DataFrame) -> DataFrame:
    """Mean of −ln σ(positive − negative) over all (positive, negative) rows."""
    return _against_positive(scored, "score").agg(F.avg(_softplus(F.col("neg") - F.col("pos"))).alias("loss"))


def contrastive(measured: DataFrame, margin: float = 1.0) -> DataFrame:
    """Mean over queries of d(positive)² + Σ max(0, margin − d(negative))²."""
    near = F.pow(F.greatest(F.lit(margin) - F.col("distance"), F.lit(0.0)), F.lit(2.0))
    term = F.when(F.expr(_IS_POSITIVE), F.col("distance") * F.col("distance")).otherwise(near)
    per_query = measured.groupBy("query_id").agg(F.sum(term).alias("loss"))
    return per_query.agg(F.avg("loss").alias("loss"))


def triplet(measured: DataFrame, margin: float = 1.0) -> DataFrame:
    """Mean over queries of the mean of max(0, d(positive) − d(negative) + margin)."""
    rows = _against_positive(measured, "distance")
    term = F.greatest(F.col("pos") - F.col("neg") + margin, F.lit(0.0))
    return rows.groupBy("query_id").agg(F.avg(term).alias("loss")).agg(F.avg("loss").alias("loss"))


def bce_with_logits(scored: DataFrame) -> DataFrame:
    x, y = F.col("score"), F.col("label")
    return scored.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("loss"))


def mse(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("loss"))


def weighted_sum(losses: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None) -> DataFrame:
    """``(name, loss, weight)`` per objective and a ``total`` row with Σ weight·loss."""
    weights = weights or {name: 1.0 for name in losses}
    rows = None
    for name, loss in losses.items():
        part = loss.select(F.lit(name).alias("name"), "loss", F.lit(float(weights[name])).alias("weight"))
        rows = part if rows is None else rows.unionByName(part)
    total = rows.agg(F.sum(F.col("loss") * F.col("weight")).alias("loss"))
    return rows.unionByName(total.select(F.lit("total").alias("name"), "loss", F.lit(1.0).alias("weight")))
