"""Order-dependent numbers over a whole table, without putting the table or a frequent key in one task.

A window without partition keys sends every row to one task, and a window
over a very frequent key sends that key's rows there.  The operators here
range-partition by the full order instead, work inside the partitions, and
carry over what the partitions before contribute: an offset, or a few rows.
They do so at every size.  The laid-out rows are settled first, so what is
carried over and the rows it applies to come from the same layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.session import settle


def lay_out(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows in range partitions of ``order``, tagged with partition and position.

    The number of partitions is that of any shuffle, so small tables take the same way as large ones.
    """
    tag = F.monotonically_increasing_id()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settle(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_tag", tag))
    return rows.select(
        *df.columns,
        F.shiftright("_tag", 33).alias("_part"),
        F.col("_tag").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    )


def _earlier(col: str, window) -> Column:
    return F.coalesce(F.sum(col).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _starts(rows: DataFrame) -> DataFrame:
    """``(_part, _n, _start)``: size of each range partition and the rows before it; one row per partition."""
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    return parts.withColumn("_start", _earlier("_n", W.orderBy("_part")))


def row_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds 0, 1, 2, … in ``order``, which must leave no ties."""
    rows = lay_out(df, order)
    # One row per range partition: bounded by the partition count, whatever the data.
    starts = F.broadcast(_starts(rows).select("_part", "_start"))
    return rows.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_pos")).cast("long").alias(name))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str, name: str, total: str | None = None) -> DataFrame:
    """Adds the sum of ``weight`` over the rows of the same keys that come earlier in ``order``, and the one over all of them as ``total``."""
    rows = lay_out(df, [*map(F.col, keys), *order])
    sums = rows.groupBy("_part", *keys).agg(F.sum(weight).alias("_sum"))
    carried = sums.withColumn("_carried", _earlier("_sum", W.partitionBy(*keys).orderBy("_part")))
    # Only the first and the last key of a partition can lie in others too: two rows per partition at most.
    key = W.partitionBy(*keys)
    carried = carried.withColumns({"_whole": F.sum("_sum").over(key), "_again": F.count(F.lit(1)).over(key) > 1}).where("_again")
    carried = carried.select(F.col("_part").alias("_of"), F.struct(*keys).alias("_key"), "_carried", "_whole")
    inside = W.partitionBy("_part", *keys).orderBy("_pos")
    same = F.col("_part") == F.col("_of")
    if keys:
        same = same & F.struct(*keys).eqNullSafe(F.col("_key"))
    rows = rows.withColumn("_inside", _earlier(weight, inside))
    if total:
        rows = rows.withColumn("_own", F.sum(weight).over(W.partitionBy("_part", *keys)))
    spread = rows.join(F.broadcast(carried), same, "left")
    totals = [F.coalesce("_whole", "_own").alias(total)] if total else []
    return spread.select(*df.columns, (F.coalesce("_carried", F.lit(0)) + F.col("_inside")).alias(name), *totals)


def previous_values(df: DataFrame, key: str, order: Sequence[str], value: str, name: str, count: int) -> DataFrame:
    """Adds the array of the ``count`` values of the same key just before each row."""
    rows = lay_out(df, [F.col(c) for c in (key, *order)])
    return previous_in_layout(rows, key, value, name, count)


def previous_in_layout(rows: DataFrame, key: str, value: str, name: str, count: int) -> DataFrame:
    """``previous_values`` of rows that ``lay_out`` has put in the order of key and time.

    The last ``count`` rows before a range partition are copied into it as context.
    """
    columns = [c for c in rows.columns if c not in ("_part", "_pos")]
    # One row per range partition, with the next ones: no more than `count` of them can begin so near.
    after = F.collect_list(F.struct("_start", "_part")).over(W.orderBy("_part").rowsBetween(1, count))
    starts = _starts(rows).withColumn("_next", after)
    rows = rows.join(F.broadcast(starts), "_part").withColumn("_row", F.col("_start") + F.col("_pos"))
    follows = F.filter("_next", lambda p: p["_start"] <= F.col("_row") + count)
    follows = F.transform(follows, lambda p: p["_part"])
    own = F.array("_part")
    runs = F.when(F.col("_pos") >= F.col("_n") - count, F.concat(own, follows)).otherwise(own)
    in_run = W.partitionBy("_run", key).orderBy("_row").rowsBetween(-count, -1)
    return (
        rows.withColumn("_run", F.explode(runs))
        .withColumn(name, F.collect_list(value).over(in_run))
        .where(F.col("_run") == F.col("_part"))
        .select(*columns, name)
    )


def all_ranks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds the 1-based rank of every row within its keys, however many rows a key has."""
    ranked = running_total(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", "_before")
    return ranked.withColumn(name, F.col("_before") + 1).drop("_one", "_before")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, with their 1-based rank.

    The rank filter directly above the window lets Spark keep only ``k`` rows
    per key and task before the shuffle, so a frequent key stays small.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))
