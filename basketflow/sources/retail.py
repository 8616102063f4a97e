"""The star-schema test tables as raw sales lines, event lines and item vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One raw sales line per lineitem row; lines flagged R count as returns."""
    read = lambda name: table(spark, folder, name)
    lines = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    buyers = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = lines.join(buyers.select("c_custkey", "n_name"), F.col("o_custkey") == F.col("c_custkey"))
    prefix = F.when(F.col("l_returnflag") == "R", "C").otherwise("")
    return lines.select(
        F.col("l_partkey").cast("string").alias("stock_code"),
        F.col("p_name").alias("description"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("line_amount"),
        F.col("o_orderdate").alias("invoice_date"),
        F.col("n_name").alias("country"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("l_suppkey").cast("string").alias("vendor"),
        F.concat(prefix, F.col("l_orderkey").cast("string")).alias("unique_transaction"),
    )


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One line per event: the item is ``k`` in its properties; ids are dense already."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("customer_id"),
        F.col("user_id").alias("user_idx"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("item_idx"),
        "ts",
        "event_id",
        F.col("event_type").alias("country"),
    )


def item_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_idx"), F.col("embedding").alias("vector"))
