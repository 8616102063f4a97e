"""Ranking features per (query, candidate), training rows, re-ordering, ranker mixes."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.functions.mixing import mix, mix_unit
from basketflow.functions.rounding import rounded
from basketflow.functions.vectors import NORM_FLOOR, SCORE_DIGITS, bounds, flat, unit_rows
from basketflow.operators.blocks import WHOLE_ROWS, meet, ranges, stored_matrix
from basketflow.operators.gathering import BucketedVectors, rows_of
from basketflow.operators.ordering import top_rows
from basketflow.operators.retrieval import top_items
from basketflow.operators.sequences import MAX_HISTORY, last_items
from basketflow.session import settle

FEATURE_BLOCK = 2_048  # queries whose lists meet the catalog at a time
FEATURE_CHUNK = 64  # queries whose features are computed at a time
FEATURES = ("dot_uv", "max_sim_recent", "pop", "hist_len", "price_z")


def popularity_feature(train: DataFrame) -> DataFrame:
    """``(item_idx, pop)``: count as next item in training, scaled to [0, 1]."""
    counts = train.groupBy(F.col("pos_item_idx").alias("item_idx")).agg(F.count(F.lit(1)).alias("n"))
    range_ = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select(F.struct("lo", "hi")).scalar()
    return counts.select("item_idx", ((F.col("n") - range_["lo"]) / (range_["hi"] - range_["lo"] + 1e-9)).alias("pop"))


def price_feature(items: DataFrame, item_map: DataFrame) -> DataFrame:
    """``(item_idx, price_z)``: how far the median price lies from the catalog mean."""
    prices = items.select("stock_code", "price_median").where(F.col("price_median").isNotNull())
    prices = prices.join(item_map, "stock_code").select("item_idx", "price_median")
    shape = prices.agg(F.avg("price_median").alias("mean"), F.stddev_samp("price_median").alias("std"))
    shape = shape.select(F.struct("mean", "std")).scalar()
    return prices.select("item_idx", ((F.col("price_median") - shape["mean"]) / (shape["std"] + 1e-6)).alias("price_z"))


class _PairFeatures:
    """Vector features of a block of queries, from the vectors that its lists name in all blocks of the catalog."""

    def __init__(self, max_history: int, lookups: tuple[str, ...], block: pa.Table):
        self.max_history, self.block = max_history, block
        of_block = lambda name: flat(block[name]).flatten().to_numpy(zero_copy_only=False)
        self.wanted = np.unique(np.append(of_block("hist"), of_block("items")))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.looked: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {name: [] for name in lookups}

    def _look(self, name: str, block: pa.Table):
        """Keeps the values of a lookup table for the items that the lists name."""
        ids, values = block["item_idx"].to_numpy(), block[name].to_numpy()
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
        wanted = self.wanted[slice(*np.searchsorted(self.wanted, [ids[0], ids[-1] + 1]))] if len(ids) else self.wanted[:0]
        start = np.searchsorted(ids, wanted, side="left")
        taken = ranges(start, np.searchsorted(ids, wanted, side="right") - start)
        self.looked[name].append((ids[taken], values[taken]))
        return ()

    def add(self, block: pa.Table):
        if "vector" not in block.column_names:
            return self._look(block.column_names[1], block)
        ids = block["item_idx"].to_numpy()
        if len(self.wanted):
            place = np.minimum(np.searchsorted(self.wanted, ids), len(self.wanted) - 1)
            met = np.flatnonzero(self.wanted[place] == ids)
            if len(met):
                self.found.append((ids[met], stored_matrix(block["vector"])[met]))
        return ()

    def end(self):
        ids, vectors = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64), np.zeros((0, 1)))
        self.found = []  # the pieces are not needed beside the whole
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, vectors = ids[order], vectors[order]
        stored = self._runs(ids)
        looked = {}
        for name, found in self.looked.items():
            of, values = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0))
            order = np.argsort(of, kind="stable")
            looked[name] = *self._runs(of[order]), values[order]
        for at in range(0, self.block.num_rows, FEATURE_CHUNK):
            yield self._features(self.block.slice(at, FEATURE_CHUNK), stored, vectors, looked)

    def _runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each wanted item begin among sorted ids, and how many they are."""
        start = np.searchsorted(ids, self.wanted, side="left")
        return start, np.searchsorted(ids, self.wanted, side="right") - start

    @staticmethod
    def _with_lookups(batch: pa.RecordBatch, place: np.ndarray, looked: dict) -> pa.RecordBatch:
        """The rows with the values of their items, 0 without one, as a left join has them; ``place`` is that of an item among the wanted."""
        for name, (start, held, values) in looked.items():
            start, held = start[place], held[place]
            if (held > 1).any():
                entry = np.repeat(np.arange(len(place)), np.maximum(held, 1))
                batch, place = batch.take(pa.array(entry)), place[entry]
            column = np.zeros(batch.num_rows)
            column[np.repeat(held, np.maximum(held, 1)) > 0] = values[ranges(start, held)]
            batch = batch.append_column(name, pa.array(column))
        return batch

    def _features(self, block: pa.Table, stored: tuple[np.ndarray, np.ndarray], vectors: np.ndarray, looked: dict) -> pa.RecordBatch:
        n_rows, dim = block.num_rows, vectors.shape[1]
        hist, cand, slots = (flat(block[c]) for c in ("hist", "items", "slots"))
        of_list = lambda column: np.repeat(np.arange(n_rows), np.diff(bounds(column)))
        place = np.searchsorted(self.wanted, hist.flatten().to_numpy(zero_copy_only=False))
        start, held = (x[place] for x in stored)
        h_all, h_row = vectors[ranges(start, held)].astype(np.float64), np.repeat(of_list(hist), held)
        items = cand.flatten().to_numpy(zero_copy_only=False)
        place = np.searchsorted(self.wanted, items)
        start, held = (x[place] for x in stored)
        # a candidate without a vector keeps its row, with a zero vector
        entry = np.repeat(np.arange(len(items)), np.maximum(held, 1))
        of = of_list(cand)[entry]
        known = held[entry] > 0
        found = ranges(start, held)
        dots, sims = np.zeros(len(entry)), np.zeros(len(entry))
        # Per query one product of its known candidates with its mean and the unit vectors of its history.
        h_unit, h_ends = unit_rows(h_all), np.searchsorted(h_row, np.arange(n_rows + 1))
        c_of = of[known]
        c_ends = np.searchsorted(c_of, np.arange(n_rows + 1))
        c_dots, c_sims = np.zeros(len(found)), np.zeros(len(found))
        for row in range(n_rows):
            mine, theirs = slice(*h_ends[row:row + 2]), slice(*c_ends[row:row + 2])
            if theirs.stop == theirs.start:
                continue
            mean = unit_rows(h_all[mine].sum(axis=0, keepdims=True) / max(mine.stop - mine.start, 1))
            c = vectors[found[theirs]].astype(np.float64)
            products = np.concatenate([mean, h_unit[mine]]) @ c.T
            c_dots[theirs] = products[0]
            if mine.stop > mine.start:
                c_sims[theirs] = products[1:].max(axis=0) / np.maximum(np.sqrt(np.einsum("cd,cd->c", c, c)), NORM_FLOOR)
        dots[known], sims[known] = c_dots, c_sims
        taken = pa.array(of)
        batch = pa.record_batch({
            "query_id": flat(block["query_id"]).take(taken),
            "item_idx": cand.flatten().take(pa.array(entry)),
            "slot": slots.flatten().cast(pa.int64()).take(pa.array(entry)),
            "dot_uv": dots,
            "max_sim_recent": sims,
            "hist_len": flat(block["n_hist"]).take(taken).to_numpy(zero_copy_only=False) / float(self.max_history),
            "label": (items[entry] == flat(block["pos_item_idx"]).take(taken).to_numpy(zero_copy_only=False)).astype(np.float64),
        })
        return self._with_lookups(batch, place[entry], looked)


def pair_features(
    queries: DataFrame, vectors: DataFrame | BucketedVectors, max_history: int = MAX_HISTORY, lookups: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Vector features of each candidate: ``query_id, item_idx, slot, dot_uv, max_sim_recent, hist_len, label``, and those of ``lookups``.

    Only the lists of items are grouped.  A block of queries meets the catalog
    where it lies, keeps the vectors that its lists name, as they are stored,
    and is one NumPy product per chunk; both lists have a fixed bound (history
    length, k).  History items without a vector are passed over; a candidate
    without one keeps its row, with 0 in both vector features.  ``lookups``
    are (item_idx, name) tables whose values are added in the same pass, so
    the rows are not joined by item; an unknown or null value is 0.
    """
    own = queries.select("query_id", "pos_item_idx", last_items(F.col("history"), max_history).alias("history"), "cands")
    # A candidate's slot is its place in its list and is counted after the exchange.
    slots = F.flatten(F.transform("c", lambda c: F.transform(c, lambda _, i: i.cast("long"))))
    lists = own.groupBy("query_id").agg(
        F.first("pos_item_idx").cast("long").alias("pos_item_idx"), F.first(F.size("history")).cast("long").alias("n_hist"),
        F.flatten(F.collect_list(F.filter("history", lambda x: x.isNotNull()).cast("array<bigint>"))).alias("hist"),
        F.collect_list(F.col("cands").cast("array<bigint>")).alias("c"),
    )
    lists = lists.select("query_id", "pos_item_idx", "n_hist", "hist", F.flatten("c").alias("items"), slots.alias("slots")).where(F.size("items") > 0)
    stored = rows_of(vectors).where(F.col("item_idx").isNotNull() & F.col("vector").isNotNull())
    stored = stored.select(F.col("item_idx").cast("long").alias("item_idx"), "vector")
    tables = lookups or {}
    names = tuple(tables)
    # in order of the item, so that a block of values is met by few of the wanted items
    values = [
        settle(t.where(F.col("item_idx").isNotNull())
               .select(F.col("item_idx").cast("long").alias("item_idx"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n)).sort("item_idx"))
        for n, t in tables.items()
    ]
    kind = "query_id long, item_idx long, slot long, dot_uv double, max_sim_recent double, hist_len double, label double"
    return meet(
        lists, stored, FEATURE_BLOCK, WHOLE_ROWS, lambda block: _PairFeatures(max_history, names, block),
        ", ".join([kind, *(f"{n} double" for n in names)]), whole=True, lookups=values,
    )


def build_features(
    queries: DataFrame,
    vectors: DataFrame | BucketedVectors,
    pop: DataFrame | None = None,
    price: DataFrame | None = None,
    max_history: int = MAX_HISTORY,
) -> DataFrame:
    """The five ranking features and the label per (query, candidate); unknown pop and price are 0."""
    given = {name: table for name, table in (("pop", pop), ("price_z", price)) if table is not None}
    rows = pair_features(queries, vectors, max_history, given)
    for name in ("pop", "price_z"):
        if name not in given:
            rows = rows.withColumn(name, F.lit(0.0))
    return rows.select("query_id", "item_idx", "slot", *FEATURES, "label")


def _positive_first(features: DataFrame, n: int, order) -> DataFrame:
    return top_rows(features, ["query_id"], [F.col("label").desc(), *order, F.col("item_idx")], n + 1)


def hard_negatives(features: DataFrame, n: int = 20) -> DataFrame:
    """The positive and its n highest-scoring negatives by ``dot_uv``; ``rank`` 1 is the positive."""
    return _positive_first(features, n, [rounded(F.col("dot_uv"), SCORE_DIGITS).desc()])


def random_negatives(features: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """The positive and n seeded-random negatives of the candidate list."""
    return _positive_first(features, n, [mix(seed, F.col("query_id"), F.col("item_idx"))])


def mask_features(features: DataFrame, columns=("dot_uv",), share: float = 0.3, seed: int = 42) -> DataFrame:
    """Sets each listed feature to 0 in about ``share`` of the rows, each column drawn on its own."""
    if share <= 0:
        return features
    for i, c in enumerate(columns):
        kept = mix_unit(seed + i, F.col("query_id"), F.col("item_idx")) > share
        features = features.withColumn(c, F.when(kept, F.col(c)).otherwise(F.lit(0.0)))
    return features


def rerank(scored: DataFrame, k: int) -> DataFrame:
    """Candidates by score; equal scores by item."""
    return top_items(scored.withColumn("score", rounded(F.col("score"), SCORE_DIGITS)), k)


def rerank_or_keep(queries: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Re-ranked lists; a query without any score keeps its candidate order with score 1.0."""
    # Settled: scores are computed once, and who has any shows in the short lists.
    best = settle(rerank(scored.where(F.col("score").isNotNull()), k))
    without = queries.select("query_id", F.slice("cands", 1, k).alias("cands")).join(best.select("query_id").distinct(), "query_id", "left_anti")
    kept = without.select("query_id", F.posexplode("cands").alias("slot", "item_idx")).select(
        "query_id", (F.col("slot") + 1).cast("long").alias("rank"), "item_idx", F.lit(1.0).alias("score")
    )
    return best.unionByName(kept)


def mix_rankers(
    queries: DataFrame,
    ranked: Mapping[str, DataFrame],
    k: int,
    weights: Mapping[str, float] | None = None,
    method: str = "average",
) -> DataFrame:
    """Average, max or min of weight·score over the rankers that returned a candidate, 0 if none did."""
    weights = weights or {name: 1.0 for name in ranked}
    total = sum(weights[name] for name in ranked)
    rows = None
    for name, table in ranked.items():
        part = table.select("query_id", "item_idx", (F.col("score") * (weights[name] / total)).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    combine = {"max": F.max, "min": F.min}.get(method, F.avg)
    mixed = rows.groupBy("query_id", "item_idx").agg(combine("score").alias("score"))
    # Of the candidates that no ranker returned, all at score 0, the k lowest can be among the best: lists stay lists.
    entry = F.struct(F.round("score", SCORE_DIGITS).alias("score"), "item_idx")
    mixed = mixed.where(F.col("item_idx").isNotNull()).groupBy("query_id").agg(F.collect_list(entry).alias("_mixed"))
    own = queries.select("query_id", "cands").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("cands"))).alias("_cands"))
    full = own.join(mixed, "query_id", "left").withColumn("_mixed", F.coalesce("_mixed", F.array().cast(mixed.schema["_mixed"].dataType)))
    found = F.filter("_mixed", lambda m: F.coalesce(F.array_contains("_cands", m["item_idx"]), F.lit(False)))
    rest = F.slice(F.sort_array(F.array_except("_cands", F.col("_mixed.item_idx"))), 1, k)
    zeros = F.transform(rest, lambda i: F.struct(F.lit(0.0).alias("score"), i.alias("item_idx")))
    return top_items(full.select("query_id", F.inline(F.concat(found, zeros))), k)
