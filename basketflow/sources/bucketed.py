"""Tables in buckets of a key: a join on the key moves only the other side.

The files and a one-row layout lie in a folder; a session that reads it
names the files as a bucketed table of its catalog, without copying them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow.sources.tables import read_report, write_report

BUCKET_BYTES = 128 << 20


def bucket_count(rows: int, row_bytes: int, at_least: int = 1, bucket_bytes: int = BUCKET_BYTES) -> int:
    """So many buckets that one holds about ``bucket_bytes``."""
    return max(at_least, -(-rows * row_bytes // bucket_bytes), 1)


def _name(path: str) -> str:
    return f"bucketed_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One shuffle by ``key``, one sorted file per bucket; replaces what lies in the folder."""
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    writer.format("parquet").option("path", f"{path}/data").saveAsTable(_name(path))
    layout = df.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(buckets).alias("buckets"))
    write_report(layout, f"{path}/layout")


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_bucketed`` wrote, in this or another session; a join on its key needs no exchange of it."""
    name = _name(path)
    if not spark.catalog.tableExists(name):
        layout = read_report(spark, f"{path}/layout", "key string, buckets int").head()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/data").schema)
        spark.sql(
            f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{layout.key}`) SORTED BY (`{layout.key}`) "
            f"INTO {layout.buckets} BUCKETS LOCATION '{path}/data'"
        )
    return spark.table(name)
