"""Exact top-k inner products: candidates by descending length, rotated partial sums, Cauchy-Schwarz bounds.

Vectors are rotated by the singular vectors of the whole table, which puts
most of their length into the first components.  The product of two vectors
is their product over the first components plus at most the product of the
lengths of the rests.  Candidates are taken by descending length in blocks:

1. every query meets the first block, which gives it a lowest score to beat;
2. a query goes on to a block only while its length times the block's largest
   length can reach that score;
3. in a block, slice by slice, candidates are pruned by length, then by the
   partial sum plus the product of the rests; integer products decide the rest.

A task holds one block of queries and one of candidates.  Bounds carry a
margin for rounding, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.operators.ordering import row_index, top_rows
from basketflow.session import Scratch, settle

QUERY_BLOCK, VECTOR_BLOCK, SLICE = 1024, 8192, 512
ENERGY = 0.6  # of the squared lengths, in the components that are summed first


def integer_vectors(table: DataFrame, factor: float = 64.0) -> DataFrame:
    """Rows (vec_id, v): floor(factor * x) of every component as a long; rows that take no part are left out.

    Out are null ids, null vectors and vectors with null or non-finite components.
    """
    exact = F.transform("embedding", lambda x: x.cast("double"))
    # a comparison with null is null, so exists() asks for what must hold
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(exact, lambda x: F.floor(x * factor).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, shorter ones filled with zeros."""
    rows = np.zeros((len(column), width), np.int64)
    for i, row in enumerate(column):
        values = row.values.to_numpy()
        rows[i, : len(values)] = values
    return rows


def rotation(vectors: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """The singular vectors of the whole table by descending weight, and how many hold ENERGY of it.

    Tasks send sums of products, width x width numbers each; tasks of one
    group are added before the driver sees them.
    """

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = _matrix(batch.column(0), width).astype(float)
            total += rows.T @ rows
        place = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "x"])

    sums = vectors.select("v").mapInArrow(gram, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros(width * width)
    total[sums["place"].to_numpy()] = sums["x"].to_numpy()
    weights, basis = np.linalg.eigh(total.reshape(width, width))
    weights, basis = np.maximum(weights[::-1], 0), basis[:, ::-1]
    share = np.cumsum(weights) / max(weights.sum(), 1e-300)
    return basis, int(np.searchsorted(share, ENERGY) + 1)


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer products; floats hold them where lengths allow no more than 53 bits."""
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if largest < 2**52 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, then the smaller row."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((rows[kept], ids[kept], -scores[kept]))[:k]]


def _search(k: int, basis: np.ndarray, head: int, width: int):
    """Top k of a block of queries among a block of candidates, which come by descending length."""

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            queries, vectors = _matrix(left["v"].combine_chunks(), width), _matrix(right["v"].combine_chunks(), width)
            least = left["least"].to_numpy().astype(float)
            own, rows, ids = left["_row"].to_numpy(), right["_row"].to_numpy(), right["vec_id"].to_numpy()
            order = np.argsort(rows)
            vectors, rows, ids = vectors[order], rows[order], ids[order]
            turned_q, turned_v = queries @ basis, vectors @ basis
            length_q, length_v = (np.sqrt((x.astype(float) ** 2).sum(axis=1)) for x in (queries, vectors))
            rest_q, rest_v = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (turned_q, turned_v))
            # rounding of the rotated sums, far above what doubles lose
            margin = 1e-6 + 1e-9 * length_q[:, None] * max(length_v.max(), 1.0)
            held = [(np.empty(0, np.int64),) * 3 for _ in own]
            largest = float(length_q.max() * length_v.max())
            for start in range(0, len(rows), SLICE):
                part = slice(start, start + SLICE)
                alive = np.flatnonzero(length_q * length_v[start] + margin[:, 0] >= least)
                if not len(alive):
                    break
                bound = turned_q[alive, :head] @ turned_v[part, :head].T + rest_q[alive, None] * rest_v[None, part]
                possible = bound + margin[alive] >= least[alive, None]
                some = np.flatnonzero(possible.any(axis=1))
                if not len(some):
                    continue
                products = _products(queries[alive[some]], vectors[part], largest)
                for i, row, wanted in zip(alive[some].tolist(), products, possible[some], strict=True):
                    wanted = wanted & (rows[part] != own[i])
                    scores = np.concatenate([held[i][0], row[wanted]])
                    found = [np.concatenate([h, x[part][wanted]]) for h, x in zip(held[i][1:], (ids, rows), strict=True)]
                    top = _best(scores, *found, k)
                    held[i] = (scores[top], found[0][top], found[1][top])
                    if len(top) == k:
                        least[i] = max(least[i], float(scores[top[-1]]))
            for row, (scores, found, places) in zip(own, held, strict=True):
                for column, values in zip(out, (np.full(len(scores), row), found, places, scores), strict=True):
                    column.append(values)
        columns = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(columns, names=["_query", "vec_id", "_row", "score"])

    return run


def top_products(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k largest inner products of every query, ties to the smaller id.

    ``vectors`` has rows (vec_id, v array<long>); ``queries`` is the condition
    that selects the query rows.  Candidates of a query are all rows but its
    own; rows that repeat an id or a vector are rows of their own.  Shorter
    vectors count as filled with zeros.  A query with fewer candidates than k
    gets them all.  Products must fit into a long.  The result is settled.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        measured = vectors.select("vec_id", "v", squares.alias("_square"))
        # equal lengths are spread by id and content, so one repeated vector fills no task alone
        rows = scratch.settle(row_index(measured, [F.desc("_square"), F.asc("vec_id"), F.xxhash64("v")], "_row"))
        width, count = rows.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
        if not count:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        width = max(width, 1)
        basis, head = rotation(rows, width)
        # a block stays within a few dozen MB whatever the width
        vector_block = max(64, min(VECTOR_BLOCK, (1 << 22) // width))
        query_block = max(64, min(QUERY_BLOCK, (1 << 20) // width))
        rows = rows.withColumn("_block", F.floor(F.col("_row") / vector_block))
        asked = rows.where(queries).select("_row", "vec_id", "v", "_square")
        groups = max(1, -(-asked.count() // query_block))
        asked = scratch.settle(asked.withColumn("_asks", F.pmod(F.xxhash64("_row"), F.lit(groups))))
        search = _search(k, basis, head, width)

        def meet(pairs: DataFrame, asking: DataFrame) -> DataFrame:
            """The tops of all pairs (_asks, _block) of a block of queries and one of candidates."""
            left = asking.join(pairs, "_asks").select("_asks", "_block", "_row", "v", "least")
            own = pairs.select(F.col("_asks").alias("_group"), F.col("_block").alias("_of"))
            right = rows.join(own, F.col("_block") == F.col("_of")).select("_group", "_of", "_row", "vec_id", "v")
            return left.groupBy("_asks", "_block").cogroup(right.groupBy("_group", "_of")).applyInArrow(search, "_query long, vec_id long, _row long, score long")

        first_pairs = asked.select("_asks", F.lit(0).cast("long").alias("_block")).distinct()
        first = scratch.settle(meet(first_pairs, asked.withColumn("least", F.lit(float("-inf")))))
        least = first.groupBy("_query").agg(F.min("score").alias("_low"), F.count(F.lit(1)).alias("_n"))
        least = least.select("_query", F.when(F.col("_n") == k, F.col("_low").cast("double")).alias("least"))
        bounded = asked.join(least, asked["_row"] == least["_query"], "left").drop("_query")
        bounded = scratch.settle(bounded.withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
        # blocks come by falling length: a block of queries needs those whose longest vector can reach some least score
        reach = F.when(F.col("least") <= 0, F.lit(0.0)).otherwise(F.pow("least", F.lit(2)) / F.col("_square") * (1 - 1e-9))
        lengths = rows.groupBy("_block").agg(F.max("_square").alias("_largest"))
        last = -(-count // vector_block) - 1
        later = F.sequence(F.lit(1).cast("long"), F.lit(last).cast("long")) if last > 0 else F.array().cast("array<long>")
        pairs = bounded.groupBy("_asks").agg(F.min(reach).alias("_reach")).withColumn("_block", F.explode(later))
        pairs = pairs.join(lengths, "_block").where("_largest >= _reach").select("_asks", "_block")
        later = meet(pairs, bounded)
        ranked = top_rows(first.union(later), ["_query"], [F.desc("score"), F.asc("vec_id"), F.asc("_row")], k)
        names = asked.select(F.col("_row").alias("_query"), F.col("vec_id").alias("query_id"))
        result = ranked.join(names, "_query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        return settle(result)
