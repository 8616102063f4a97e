"""Ranking quality: recall, NDCG, MRR, coverage and diversity at several K in one pass per table.

Lists are long rows ``(model, query_id, rank, item_idx)``; truths are
``(query_id, truth)`` with one row per query.  A query without a list counts
as a miss.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions.rounding import rounded
from basketflow.functions.vectors import as_matrix, bounds, flat, unit_rows


def from_lists(df: DataFrame, name: str = "recs") -> DataFrame:
    """One row per list entry, ranks from 1."""
    other = [c for c in df.columns if c not in (name, "truth")]
    rows = df.select(*other, F.posexplode(name).alias("rank", "item_idx"))
    return rows.withColumn("rank", (F.col("rank") + 1).cast("long"))


def rank_of(recs: Column, truth: Column, k: int) -> Column:
    """1-based place of the truth in the first k entries, null when absent."""
    place = F.array_position(F.slice(recs, 1, k), truth)
    return F.when(place > 0, place)


def truth_ranks(lists: DataFrame, truths: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(model, query_id, hit)``: rank of the truth, null on a miss; every query once per model.

    Settled lists pack so well that Spark takes millions of them for a table
    to broadcast, through the driver: they are merged with the truths.
    """
    truths = truths.select("query_id", "truth")
    hits = lists.hint("merge").join(truths, "query_id").where(F.col("item_idx") == F.col("truth"))
    hits = hits.groupBy("model", "query_id").agg(F.min("rank").alias("hit"))
    all_ = truths.select("query_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return all_.join(hits, ["model", "query_id"], "left")


def _tidy(df: DataFrame, keys: list[str], cells: dict[tuple[str, int], str]) -> DataFrame:
    rows = [
        F.struct(F.lit(m).alias("metric"), F.lit(k).cast("long").alias("k"),
                 F.coalesce(F.col(c), F.lit(0.0)).alias("value"))
        for (m, k), c in cells.items()
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def _of_every(models: Sequence[str] | None, table: DataFrame) -> DataFrame:
    """``table`` with a row for each of ``models``, empty where it has none."""
    if models is None:
        return table
    names = table.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return names.join(table, "model", "left")


def ranking_metrics(ranks: DataFrame, ks: Sequence[int], models: Sequence[str] | None = None) -> DataFrame:
    """Recall, NDCG and MRR from ``truth_ranks``; 0 for those of ``models`` without any query."""
    columns, cells = [], {}
    for k in ks:
        within = F.col("hit") <= k
        gains = {
            "Recall": F.lit(1.0),
            "NDCG": F.lit(1.0) / F.log2(F.col("hit") + 1.0),
            "MRR": F.lit(1.0) / F.col("hit"),
        }
        for metric, gain in gains.items():
            cells[metric, k] = f"{metric}_{k}"
            columns.append(F.avg(F.when(within, gain).otherwise(0.0)).alias(f"{metric}_{k}"))
    return _tidy(_of_every(models, ranks.groupBy("model").agg(*columns)), ["model"], cells)


def _item_bits(k: int | None) -> Column:
    """A bitmap of the items of one bucket, of those up to rank ``k``."""
    place = F.bitmap_bit_position("item_idx")
    return F.bitmap_construct_agg(place if k is None else F.when(F.col("rank") <= k, place))


def coverage_metrics(lists: DataFrame, n_items: int, ks: Sequence[int], models: Sequence[str] | None = None) -> DataFrame:
    """Share of the catalog that occurs in some list's first k entries; 0 for those of ``models`` without lists.

    Items are bits: a task sends one bitmap per model, K and bucket of 32,768
    items, whatever the number of lists, and bitmaps are joined and counted.
    """
    buckets = lists.groupBy("model", F.bitmap_bucket_number("item_idx").alias("_bucket"))
    buckets = buckets.agg(*[_item_bits(k).alias(f"b{k}") for k in ks])
    cells = {("Coverage", k): f"c{k}" for k in ks}
    share = [(F.sum(F.bitmap_count(f"b{k}")) / float(max(n_items, 1))).alias(f"c{k}") for k in ks]
    return _tidy(_of_every(models, buckets.groupBy("model").agg(*share)), ["model"], cells)


def distinct_items(lists: DataFrame) -> DataFrame:
    """``(n)``: how many different items the lists hold, counted in bitmaps."""
    buckets = lists.groupBy(F.bitmap_bucket_number("item_idx").alias("_bucket")).agg(_item_bits(None).alias("bits"))
    return buckets.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def id_diversity(lists: DataFrame, ks: Sequence[int], models: Sequence[str] | None = None) -> DataFrame:
    """Mean share of distinct items over lists with more than one entry."""
    items = lists.groupBy("model", "query_id", "item_idx")
    counts = [F.sum((F.col("rank") <= k).cast("long")).alias(f"n{k}") for k in ks]
    items = items.agg(*counts)
    per_list = items.groupBy("model", "query_id").agg(
        *[F.sum(f"n{k}").alias(f"n{k}") for k in ks],
        *[F.sum((F.col(f"n{k}") > 0).cast("long")).alias(f"d{k}") for k in ks],
    )
    shares = [F.avg(F.when(F.col(f"n{k}") > 1, F.col(f"d{k}") / F.col(f"n{k}"))).alias(f"v{k}") for k in ks]
    return _tidy(_of_every(models, per_list.groupBy("model").agg(*shares)), ["model"], {("Diversity", k): f"v{k}" for k in ks})


def _list_spread(ks: Sequence[int]):
    def compute(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            vectors = flat(at["vectors"])
            to, rows = bounds(vectors), unit_rows(as_matrix(vectors.flatten()))
            gap, n = (at[c].to_numpy(zero_copy_only=False) for c in ("gap", "n"))
            squares = (rows * rows).sum(axis=1)
            for k in ks:
                m = np.minimum(k, n)
                good = np.flatnonzero((m >= 2) & (gap > m))
                if not len(good):
                    continue
                size = m[good]
                # the first m rows of each list, one list after the other
                starts = np.cumsum(size) - size
                heads = np.arange(size.sum()) - np.repeat(starts - to[:-1][good], size)
                sums = np.add.reduceat(rows[heads], starts, axis=0)
                own = np.add.reduceat(squares[heads], starts)
                apart = ((sums * sums).sum(axis=1) - own) / (size * (size - 1))
                lists = pa.array(good)
                yield pa.record_batch({
                    "model": at["model"].take(lists), "query_id": at["query_id"].take(lists),
                    "k": pa.array(np.full(len(good), k), pa.int64()), "spread": pa.array(1.0 - apart, pa.float64()),
                })
    return compute


def feature_diversity(
    lists: DataFrame, vectors: DataFrame, ks: Sequence[int], models: Sequence[str] | None = None
) -> DataFrame:
    """Mean of 1 − average cosine inside the list; lists with an unknown item are left out.

    The cosines of a list sum to |Σ unit vectors|² minus the diagonal, so no
    pairs are formed.
    """
    rows = lists.where(F.col("rank") <= max(ks)).join(vectors.select("item_idx", "vector"), "item_idx", "left")
    entries = F.array_sort(F.collect_list(F.when(F.col("vector").isNotNull(), F.struct("rank", "vector"))))
    first_gap = F.min(F.when(F.col("vector").isNull(), F.col("rank")))
    per_list = rows.groupBy("model", "query_id").agg(
        entries.alias("e"), F.count(F.lit(1)).alias("n"), F.coalesce(first_gap, F.lit(2**31 - 1)).alias("gap")
    )
    spread = per_list.select("model", "query_id", F.col("e.vector").alias("vectors"), "n", "gap").mapInArrow(
        _list_spread(tuple(ks)), "model string, query_id long, k long, spread double"
    )
    means = [F.avg(F.when(F.col("k") == k, F.col("spread"))).alias(f"v{k}") for k in ks]
    return _tidy(_of_every(models, spread.groupBy("model").agg(*means)), ["model"], {("Diversity", k): f"v{k}" for k in ks})


def diversity(lists: DataFrame, ks: Sequence[int], vectors: DataFrame | None = None) -> DataFrame:
    return id_diversity(lists, ks) if vectors is None else feature_diversity(lists, vectors, ks)


def all_metrics(
    lists: DataFrame,
    truths: DataFrame,
    models: Sequence[str],
    ks: Sequence[int],
    n_items: int | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """``(model, metric, k, value)`` of every metric the arguments allow, 0 where nothing was counted."""
    out = ranking_metrics(truth_ranks(lists, truths, models), ks, models)
    if n_items is not None:
        out = out.unionByName(coverage_metrics(lists, n_items, ks, models))
    if vectors is not None:
        out = out.unionByName(feature_diversity(lists, vectors, ks, models))
    return out


def recall_from_scores(scored: DataFrame, k: int) -> DataFrame:
    """Share of queries whose labelled row is among their k best scores."""
    from basketflow.operators.ordering import top_rows
    from basketflow.operators.scoring import among_best

    scored = among_best(scored.select("query_id", "item_idx", "score", "label"), k)
    best = top_rows(scored, ["query_id"], [rounded(F.col("score"), 9).desc(), F.col("item_idx")], k)
    hit = best.groupBy("query_id").agg(F.max("label").alias("hit"))
    return hit.agg(F.coalesce(F.avg((F.col("hit") > 0.5).cast("double")), F.lit(0.0)).alias("recall"))


def running_means(records: DataFrame) -> DataFrame:
    """Mean per metric weighted by sample count; 0.0 where nothing was counted."""
    total = F.sum("count")
    mean = F.when(total == 0, 0.0).otherwise(F.try_divide(F.sum(F.col("value") * F.col("count")), total))
    return records.groupBy("metric").agg(mean.alias("average"))


def best_model(metrics: DataFrame, metric: str = "Recall") -> DataFrame:
    """The model with the highest value at the largest K; the first name on a tie."""
    rows = metrics.where(F.col("metric") == metric)
    largest = rows.agg(F.max("k")).scalar()
    best = rows.where(F.col("k") == largest)
    return best.agg(
        F.min_by("model", F.struct(-F.col("value"), F.col("model"))).alias("best_model"),
        F.max("value").alias("best_value"), F.max("k").alias("k"),
    )


def improvement(metrics: DataFrame, model: str, baseline: str) -> DataFrame:
    """Per metric and K: both values, their difference and the relative change in percent."""
    pick = lambda name, alias: metrics.where(F.col("model") == name).select("metric", "k", F.col("value").alias(alias))
    rows = pick(model, "value").join(pick(baseline, "baseline"), ["metric", "k"])
    change = F.when(F.col("baseline") > 0, (F.col("value") - F.col("baseline")) / F.col("baseline") * 100).otherwise(0.0)
    return rows.select("metric", "k", "value", "baseline", (F.col("value") - F.col("baseline")).alias("delta"),
                       change.alias("improvement_pct"))


# The columns of the summary, with the K they are shown at.
SUMMARY_COLUMNS = ("Model", "Recall@{k}", "NDCG@{k}", "Coverage@{k}", "Notes")


def summary_row(metrics: DataFrame, model: str, baseline: str, k: int = 10) -> DataFrame:
    """The one-row summary: Model, Recall, NDCG, Coverage at K with 4 decimals, and a note on the NDCG change."""
    at = lambda name, metric: F.max(F.when(
        (F.col("model") == name) & (F.col("metric") == metric) & (F.col("k") == k), F.col("value")))
    wide = metrics.agg(
        at(model, "Recall").alias("recall"), at(model, "NDCG").alias("ndcg"), at(model, "Coverage").alias("coverage"),
        at(baseline, "NDCG").alias("base"),
    )
    four = lambda col: F.format_string("%.4f", col)
    note = F.concat(F.lit(f"NDCG@{k} of {model} against {baseline}: "), F.format_string("%+.4f", F.col("ndcg") - F.col("base")))
    cells = [F.lit(model), *[four(F.col(c)) for c in ("recall", "ndcg", "coverage")], note]
    return wide.select(*[c.alias(name.format(k=k)) for c, name in zip(cells, SUMMARY_COLUMNS, strict=True)])
