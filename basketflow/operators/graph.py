"""Approximate neighbors by a neighbor graph, as tables and joins.

The graph is an edge table: every item with its ``degree`` nearest known ones.
It starts from items that share a hash bucket and improves in rounds: the
neighbors of an item's neighbors, where one of the two edges is new, become
candidates, and the best ones replace worse edges, until few edges change.
Edges are followed in both directions; of the items that name a popular one,
its ``degree`` nearest are followed, so a hub is no large group.

A search keeps a pool of ``width`` best items per query.  Each round joins the
pool's items that were not yet followed with the edge table, scores what is
new, and keeps the best, until no pool changes.  Pools that end with fewer
than k items, because their part of the graph is that small, are searched
exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.functions.vectors import SCORE_DIGITS, as_matrix, bounds, flat, unit
from basketflow.operators.blocks import WHOLE_ROWS, meet, ranges
from basketflow.operators.ordering import top_rows
from basketflow.operators.retrieval import best_first, block_scores, nearest_by_hash, top_items
from basketflow.session import Scratch, settle

DEGREE = 16
WIDTH = 64
ENTRIES = 64
CHANGED = 0.01  # rounds end when a smaller share of the edges is new
QUERIES_PER_TASK = 2_048
SCORED = 1 << 16  # pairs that are scored at a time


class _Dots:
    """Scores of the items that each query of a block lists, as blocks of items pass."""

    def __init__(self, block: pa.Table):
        self.ids, self.queries, lists = flat(block["query_id"]), as_matrix(block["vector"]), flat(block["items"])
        items = lists.flatten().to_numpy()
        order = np.argsort(items, kind="stable")
        self.items, self.rows = items[order], np.repeat(np.arange(len(lists)), np.diff(bounds(lists)))[order]

    def add(self, block: pa.Table):
        ids, vectors = block["item_idx"].to_numpy(), as_matrix(block["vector"])
        start = np.searchsorted(self.items, ids, side="left")
        count = np.searchsorted(self.items, ids, side="right") - start
        rows, of = self.rows[ranges(start, count)], np.repeat(np.arange(len(ids)), count)
        for at in range(0, len(rows), SCORED):
            mine, theirs = rows[at : at + SCORED], of[at : at + SCORED]
            scores = np.einsum("rd,rd->r", vectors[theirs], self.queries[mine])
            yield pa.record_batch({"query_id": self.ids.take(pa.array(mine)), "item_idx": ids[theirs], "score": np.round(scores, SCORE_DIGITS) + 0.0})

    def end(self):
        return ()


def pair_scores(pairs: DataFrame, queries: DataFrame, items: DataFrame, count: int) -> DataFrame:
    """Scores of given (query_id, item_idx) for unit vectors.

    Only the ids are shuffled, to one list per query; blocks of about
    QUERIES_PER_TASK of ``count`` queries meet the items where those lie, so
    no vector is sent per pair.
    """
    lists = pairs.where(F.col("item_idx").isNotNull()).groupBy("query_id").agg(F.collect_list(F.col("item_idx").cast("long")).alias("items"))
    # fresh aliases: queries and items may be the same table
    own = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("vector")).dropDuplicates(["query_id"])
    stored = items.where(F.col("item_idx").isNotNull()).select(F.col("item_idx").cast("long").alias("item_idx"), "vector")
    asked = own.join(lists, "query_id")
    return meet(asked, stored, max(1, min(QUERIES_PER_TASK, count)), WHOLE_ROWS, _Dots, "query_id long, item_idx long, score double", whole=True)


def _units(rows: DataFrame, ident: str) -> DataFrame:
    return rows.select(F.col(ident).cast("long").alias(ident), unit(F.col("vector")).alias("vector"))


@dataclass(frozen=True)
class NeighborGraph:
    """``edges`` (id, near, score), ``vectors`` (item_idx, vector of length 1), and the share of new edges in each round."""

    edges: DataFrame
    vectors: DataFrame
    changes: tuple[float, ...] = ()

    @classmethod
    def build(cls, items: DataFrame, degree: int = DEGREE, rounds: int = 12, tables: int = 2, seed: int = 42) -> NeighborGraph:
        """Repeated ids are one item each only if the caller makes them so; null vectors have no place in the graph."""
        vectors = settle(_units(items.where(F.col("vector").isNotNull()), "item_idx"))
        own = vectors.withColumnRenamed("item_idx", "query_id")
        count = vectors.count()
        if not count:
            return cls(items.sparkSession.createDataFrame([], "id long, near long, score double"), vectors)
        changes: list[float] = []
        with Scratch(items.sparkSession) as scratch:
            start = nearest_by_hash(own, vectors, degree + 1, tables=tables, seed=seed)
            edges = start.where("query_id <> item_idx").select(F.col("query_id").alias("id"), F.col("item_idx").alias("near"), "score", F.lit(True).alias("new"))
            edges = scratch.settle(edges)
            for _ in range(rounds):
                reverse = edges.select(F.col("near").alias("id"), F.col("id").alias("near"), "score", "new")
                reverse = top_rows(reverse, ["id"], [F.col("score").desc(), F.col("near")], degree).drop("rank")
                both = scratch.settle(edges.unionByName(reverse).groupBy("id", "near").agg(F.max("new").alias("new")))
                further = both.select(F.col("id").alias("near"), F.col("near").alias("item_idx"), F.col("new").alias("newer"))
                met = both.join(further, "near").where((F.col("new") | F.col("newer")) & (F.col("id") != F.col("item_idx")))
                met = met.select(F.col("id").alias("query_id"), "item_idx")
                # those that name an item are candidates of it as well
                named = both.select(F.col("id").alias("query_id"), F.col("near").alias("item_idx"))
                known = edges.select(F.col("id").alias("query_id"), F.col("near").alias("item_idx"))
                met = met.unionByName(named).distinct().join(known, ["query_id", "item_idx"], "left_anti")
                scored = pair_scores(met, own, vectors, count)
                scored = scored.select(F.col("query_id").alias("id"), F.col("item_idx").alias("near"), "score", F.lit(True).alias("new"))
                every = edges.withColumn("new", F.lit(False)).unionByName(scored)
                better = top_rows(every, ["id"], [F.col("score").desc(), F.col("near")], degree).drop("rank")
                following = scratch.settle(better)
                scratch.drop(edges)
                scratch.drop(both)
                edges = following
                share = edges.agg(F.avg(F.col("new").cast("double"))).first()[0] or 0.0
                changes.append(share)
                if share < CHANGED:
                    break
            edges = settle(edges.select("id", "near", "score"))
        return cls(edges, vectors, tuple(changes))

    def write(self, path: str) -> None:
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> NeighborGraph:
        return cls(spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vectors"))


def _followed(pool: DataFrame, done: Column) -> DataFrame:
    return pool.select("query_id", "item_idx", "score", done.alias("done"))


def nearest_by_graph(queries: DataFrame, graph: NeighborGraph, k: int, width: int = WIDTH, entries: int = ENTRIES, rounds: int = 40) -> DataFrame:
    """``(query_id, rank, item_idx, score)``: the k best items by cosine that a search over the graph finds; lists are full where there are k items."""
    width = max(width, k)
    with Scratch(queries.sparkSession) as scratch:
        queries = scratch.settle(_units(queries, "query_id"))
        count = queries.count()
        # a fixed number of items, the same for every query
        doors = graph.vectors.orderBy(F.xxhash64("item_idx", F.lit(7)), "item_idx").limit(entries)
        pool = top_rows(block_scores(queries, doors, width, "dot"), ["query_id"], best_first(), width)
        pool = scratch.settle(_followed(pool, F.lit(False)))
        edges = graph.edges.select(F.col("id").alias("item_idx"), F.col("near"))
        for _ in range(rounds):
            ahead = pool.where("NOT done").select("query_id", "item_idx")
            if ahead.isEmpty():
                break
            met = ahead.join(edges, "item_idx").select("query_id", F.col("near").alias("item_idx")).distinct()
            met = met.join(pool.select("query_id", "item_idx"), ["query_id", "item_idx"], "left_anti")
            scored = _followed(pair_scores(met, queries, graph.vectors, count), F.lit(False))
            every = _followed(pool, F.lit(True)).unionByName(scored)
            following = scratch.settle(_followed(top_rows(every, ["query_id"], best_first(), width), F.col("done")))
            scratch.drop(pool)
            pool = following
        found = settle(top_items(pool, k))
        full = found.where(F.col("rank") == k).select("query_id")
        short = queries.join(full, "query_id", "left_anti")
        again = settle(top_items(block_scores(short, graph.vectors, k, "dot"), k))
    return found.join(full, "query_id", "left_semi").unionByName(again)
