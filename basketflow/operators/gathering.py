"""Vectors of listed items, out of a table in buckets of the item: the catalog is read where it lies, only the lists move."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.session import settle
from basketflow.sources.bucketed import bucket_count, read_bucketed, write_bucketed

HOT_SHARE = 1_000  # an item in more than this part of all list rows is hot: fewer than so many items


@dataclass
class BucketedVectors:
    """``(item_idx, vector)`` with one row per item, in buckets of item_idx.

    ``history_vectors``, ``pair_features`` and what builds on them take one
    in place of a table of vectors and read its files; the rows they return
    are the same.
    """

    rows: DataFrame

    @classmethod
    def write(cls, vectors: DataFrame, path: str, buckets: int | None = None) -> BucketedVectors:
        """Stores the vectors; without a number of buckets their size decides, with as many as a shuffle's partitions at least."""
        spark = vectors.sparkSession
        vectors = vectors.select("item_idx", "vector")
        if buckets is None:
            size = vectors.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).head()
            buckets = bucket_count(size.rows, 8 * size.dim + 8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        write_bucketed(vectors, path, "item_idx", buckets)
        return cls.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BucketedVectors:
        return cls(read_bucketed(spark, path))

    def gather(self, lists: DataFrame, how: str = "inner", hot_share: int = HOT_SHARE) -> DataFrame:
        """``lists`` with the vector of each row's item_idx; ``how`` is inner or left, as in a join.

        A bucket is one task, and adaptive execution cannot split it.  Items
        in more than one of ``hot_share`` rows are therefore found first, at
        most ``hot_share`` of them whatever the tables' sizes, and their
        vectors are sent to the lists.  All other rows go to the buckets.
        Rows without an item have no vector.  ``lists`` are settled.
        """
        if how not in ("inner", "left"):
            raise ValueError("how is inner or left")
        lists = settle(lists)
        named = lists.where(F.col("item_idx").isNotNull())
        counts = named.groupBy("item_idx").agg(F.count(F.lit(1)).alias("n"))
        hot = settle(counts.where(F.col("n") * hot_share > named.agg(F.count(F.lit(1)).alias("n")).scalar()).select("item_idx"))
        vectors = hot.join(self.rows.join(F.broadcast(hot), "item_idx", "left_semi"), "item_idx", how)
        out = named.join(F.broadcast(vectors), "item_idx")
        rest = named.join(F.broadcast(hot), "item_idx", "left_anti")
        out = out.unionByName(rest.join(self.rows, "item_idx", how))
        if how == "left":
            kind = self.rows.schema["vector"].dataType
            out = out.unionByName(lists.where(F.col("item_idx").isNull()).withColumn("vector", F.lit(None).cast(kind)))
        return out


def rows_of(vectors: DataFrame | BucketedVectors) -> DataFrame:
    return vectors.rows if isinstance(vectors, BucketedVectors) else vectors


def gather(lists: DataFrame, vectors: DataFrame | BucketedVectors, how: str = "inner") -> DataFrame:
    """Rows with ``item_idx`` joined to their vector; an inner join leaves out items without one."""
    if isinstance(vectors, BucketedVectors):
        return vectors.gather(lists, how)
    return lists.join(vectors.select("item_idx", "vector"), "item_idx", how)
