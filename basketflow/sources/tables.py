"""Readers and writers of the engine's tables: Parquet, CSV and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketflow.functions.mixing import mix
from basketflow.schemas import CUSTOMER_MAP, ITEM_MAP

SPLITS = ("train", "val", "test")
SHARD_ROWS = 1_000_000


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly in a folder; none for a file or a missing path."""
    system, target = _folder(spark, path)
    if not system.exists(target) or system.getFileStatus(target).isFile():
        return []
    return [status.getPath().getName() for status in system.listStatus(target)]


def read_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Raw transaction lines from Parquet or from CSV with a header, a file or a folder of such files.

    A path that does not exist raises when the table is opened.
    """
    if any(name.endswith((".csv", ".csv.gz")) for name in (path.rstrip("/"), *_names_in(spark, path))):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    return spark.read.parquet(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table; only the listed columns are read from the files."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), shard_rows: int | None = None) -> None:
    writer = df.write.mode("overwrite")
    if shard_rows:
        writer = writer.option("maxRecordsPerFile", shard_rows)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small tidy report as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def read_vectors(spark: SparkSession, path: str, ident: str = "idx", vector: str = "embedding", name: str = "item_idx") -> DataFrame:
    """``(name, vector)`` of an embedding table."""
    return spark.read.parquet(path).select(F.col(ident).alias(name), F.col(vector).alias("vector"))


def write_vectors(vectors: DataFrame, path: str, name: str = "item_idx") -> None:
    write_table(vectors.select(F.col(name).alias("idx"), F.col("vector").cast("array<float>").alias("embedding")), path)


def write_sequences(sequences: DataFrame, path: str) -> None:
    """All splits in one table, one folder per split."""
    write_table(sequences, path, ["split"])


def _splits_in(spark: SparkSession, path: str) -> set[str]:
    names = _names_in(spark, path)
    if not names:
        raise FileNotFoundError(f"no table in {path}")
    return {name.removeprefix("split=") for name in names if name.startswith("split=")}


def read_sequences(spark: SparkSession, path: str, splits: Sequence[str] = SPLITS) -> DataFrame:
    """The wanted splits; only their folders are read, and a missing one raises."""
    missing = set(splits) - _splits_in(spark, path)
    if missing:
        raise FileNotFoundError(f"no sequences for {sorted(missing)} in {path}")
    return spark.read.parquet(path).where(F.col("split").isin(*splits))


def read_candidates(spark: SparkSession, path: str, splits: Sequence[str] = SPLITS) -> tuple[DataFrame, list[str]]:
    """Candidates of the wanted splits, and the names of splits that are not there."""
    missing = sorted(set(splits) - _splits_in(spark, path))
    return spark.read.parquet(path).where(F.col("split").isin(*splits)), missing


def read_id_maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Item and customer id maps."""
    items = spark.read.parquet(f"{folder}/item_id_map").select(*ITEM_MAP.fieldNames())
    customers = spark.read.parquet(f"{folder}/customer_id_map").select(*CUSTOMER_MAP.fieldNames())
    return items, customers


def write_features(features: DataFrame, path: str, shard_rows: int = SHARD_ROWS) -> None:
    """Feature rows in files of at most ``shard_rows`` rows."""
    write_table(features, path, shard_rows=shard_rows)


def read_features(spark: SparkSession, path: str, columns: Sequence[str], seed: int | None = None) -> DataFrame:
    """Only the model's columns; with a seed in one pseudo-random order, the same on every cluster.

    The order is that of ``mix(seed, query_id, item_idx)`` over the whole table, ties by the ids.
    """
    rows = spark.read.parquet(path)
    if seed is not None:
        rows = rows.orderBy(mix(seed, F.col("query_id"), F.col("item_idx")), "query_id", "item_idx")
    return rows.select(*columns)


def write_summary(summary: DataFrame, path: str) -> None:
    """The one-row summary as CSV with a header."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def first_existing(spark: SparkSession, paths: Sequence[str], name: str) -> DataFrame:
    """Table ``name`` from the first folder that has it."""
    for path in paths:
        system, target = _folder(spark, f"{path.rstrip('/')}/{name}")
        if system.exists(target):
            return spark.read.parquet(target.toString())
    raise FileNotFoundError(f"{name} is in none of {list(paths)}")


